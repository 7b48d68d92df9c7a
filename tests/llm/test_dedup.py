"""SimHash, suffix-array and embedding operators against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from weftline.llm import embed_join, simhash, suffix_dedup
from weftline.llm.common import Forest
from weftline.llm.components import components


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(5, 400))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            if r.random() < 0.7:
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((n, " ".join(own)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One"), (n + 4, "one two"), (n + 4, "one two"), (None, "one two"), (None, "zz yy xx ww")]


def expected_components(rows, fps, radius=2):
    f = Forest()
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                f.join(a, b)
    low = {}
    for (i, _), fp in zip(rows, fps, strict=True):
        if i is not None:
            low[f.find(fp)] = min(i, low.get(f.find(fp), i))
    return [low.get(f.find(fp)) for fp in fps]


def test_fingerprint_of_long_text():
    text = " ".join(f"Word{i % 977}" for i in range(400_000))
    assert simhash.fingerprint(text) == simhash.fingerprint(text.replace(" ", "\n"))
    small = text[:9000]
    assert simhash.fingerprint(small) == plain_fingerprint(small)


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash_groups(spark, docs, scratch, tile, monkeypatch):
    rows = near_texts()
    monkeypatch.setattr(simhash, "near_links", lambda f, s, **k: links(f, s, tile=tile))
    found = simhash.simhash_groups(docs(rows), scratch).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = Counter((i, fp - (fp >> 63 << 64), c) for (i, _), fp, c in zip(rows, fps, expected_components(rows, fps), strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in found) == want


links = simhash.near_links


def test_near_links_are_exact(spark, scratch):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in r.integers(0, 64, (8, 2))]
    values = sorted({*map(int, base), *near})
    frame = spark.createDataFrame(pa.table({"fp": np.array(values, np.uint64).view(np.int64)}))
    roots = {x.node: x.root for x in components(links(frame, scratch, tile=50), scratch).collect()}
    f = Forest()
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                f.join(signed[i], signed[j])
    assert all(roots.get(x, x) == f.find(x) for x in signed)


def test_empty_tables(spark, docs, scratch):
    none = docs([])
    assert simhash.simhash_groups(none, scratch).count() == 0
    assert suffix_dedup.repeated_bytes(none, scratch).count() == 0
    assert suffix_dedup.without_repeats(none, scratch).count() == 0


def plain_repeats(rows, length):
    seen = Counter()
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, bodies, strict=True):
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(seed):
    r = random.Random(seed)
    letters = "abcdé "
    passage = ["".join(r.choice(letters) for _ in range(r.randint(20, 90))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [r.choice(passage) if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 8))]
        rows.append((i, "".join(parts)))
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, None), (62, ""), (63, "z" * 300), (64, "ab" * 150), (65, "q" + "z" * 120), (None, passage[0])]
    rows += [(70, passage[1] + "abcde" * 30 + passage[2]), (71, "cdeab" * 9), (72, "x" + "cdeab" * 8 + "cd"), (73, passage[3] + "deabc" * 20), (74, "abcde" * 7 + passage[2]), (75, ("abcde" * 12 + "y") * 3)]
    return rows


@pytest.mark.parametrize(("seed", "length", "anchor", "meet"), [(1, 40, 8, 20_000), (2, 40, 8, 3), (3, 64, 16, 20_000), (4, 30, 6, 10)])
def test_repeated_bytes(spark, docs, scratch, seed, length, anchor, meet):
    rows = repeating_texts(seed)
    found = suffix_dedup.repeated_bytes(docs(rows), scratch, length, anchor, meet).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter(plain_repeats(rows, length))


def plain_maximal(bodies, length):
    """Every string of at least length bytes that occurs twice, with unlike or no bytes before some and after some."""
    out = set()
    starts = Counter()
    places = {}
    for t, b in enumerate(bodies):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((t, i))
    for own in places.values():
        for x, (t, i) in enumerate(own):
            for u, j in own[:x]:
                a, b, c, d = bodies[t], bodies[u], i, j
                while c and d and a[c - 1] == b[d - 1]:
                    c, d = c - 1, d - 1
                n = 0
                while c + n < len(a) and d + n < len(b) and a[c + n] == b[d + n]:
                    n += 1
                out.add(a[c : c + n])
    return {(hashlib.md5(s).hexdigest(), len(s), t, i) for s in out for t, b in enumerate(bodies) for i in range(len(b) - len(s) + 1) if b[i : i + len(s)] == s} if out else starts.keys()


@pytest.mark.parametrize("seed", [1, 2])
def test_repeat_groups_are_the_maximal_repeats(spark, docs, scratch, seed):
    r = random.Random(seed)
    passage = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 70))) for _ in range(8)]
    rows = [(i, "".join(r.choice(passage) + r.choice(["", "x", "yz"]) for _ in range(r.randint(1, 4)))) for i in range(25)] + [(90, None), (91, "")]
    rows.append((92, rows[0][1]))
    bodies = sorted({(t or "").encode() for _, t in rows})
    at = {hashlib.sha256(b).hexdigest(): i for i, b in enumerate(bodies)}
    found = suffix_dedup.repeat_groups(docs(rows), scratch, 30, 8, reach=500).collect()
    assert {(x.group, x.n_bytes, at[x.sha], x.start) for x in found} == plain_maximal(bodies, 30)
    assert len(found) == len({(x.group, x.sha, x.start) for x in found}) and not any(x.open for x in found)
    assert {x.times for x in found if x.sha == hashlib.sha256(rows[0][1].encode()).hexdigest()} <= {2}
    few = {(x.group, x.n_bytes, at[x.sha], x.start, x.open) for x in suffix_dedup.repeat_groups(docs(rows), scratch, 30, 8, reach=500, most=2).collect()}
    whole = plain_maximal(bodies, 30)
    assert {x[:4] for x in few if not x[4]} <= whole
    cover = [{(t, i + k) for _, n, t, i, *_ in groups for k in range(n)} for groups in (few, whole)]
    assert cover[0] == cover[1]
    open_ = {bodies[t][i : i + n] for _, n, t, i, o in few if o}  # of many occurrences, still all of them
    assert open_ and {(s, t, i) for s in open_ for t, b in enumerate(bodies) for i in range(len(b)) if b.startswith(s, i)} == {
        (bodies[t][i : i + n], t, i) for _, n, t, i, o in few if o
    }


def test_intervals_are_the_tree():
    lcp = [1, 3, 0, 2, 2]
    nodes = {(d, a, b): c for d, a, b, c in suffix_dedup.intervals(lcp)}
    assert set(nodes) == {(3, 1, 3), (1, 0, 3), (2, 3, 6), (0, 0, 6)}
    assert nodes[2, 3, 6] == [(3, 4), (4, 5), (5, 6)]


def test_without_repeats_keeps_rows_and_whole_characters(spark, docs, scratch):
    passage = "é" * 100 + "x" * 50
    rows = [(1, "a" + passage + "b"), (2, "c" + passage), (3, None), (4, "short"), (5, "")]
    found = suffix_dedup.without_repeats(docs(rows), scratch)
    assert found.columns == docs(rows).columns
    assert {r.doc_id: r.text for r in found.collect()} == {1: "ab", 2: "c", 3: None, 4: "short", 5: ""}


def vectors(spark, rows):
    return spark.createDataFrame(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([r[1] for r in rows], pa.int32()), "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32())), "id": pa.array(["x"] * len(rows)), "row": pa.array(["y"] * len(rows))})).repartition(3)


@pytest.mark.parametrize("options", [{}, {"cell": 20, "block": 1000, "most_pivots": 64}, {"cell": 15, "block": 4, "most_pivots": 1000}])
def test_embeddings(spark, scratch, options):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        center = r.normal(size=8)
        for _ in range(r.integers(1, 7)):
            rows.append((len(rows), int(r.integers(0, 3)), (center + r.normal(size=8) * 0.12).astype(np.float32).tolist()))
    same = rows[0]
    rows += [(len(rows) + i, same[1], same[2]) for i in range(4)]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [1.0] * 7, [1.0] * 5]
    rows += [(n + i, 1, v) for i, v in enumerate(odd)] + [(n + 10, None, same[2]), (n + 11, 1, [1.0] * 5), (n + 12, 1, [1e-30] * 5), (n + 12, 1, [1e-30] * 5), (None, same[1], same[2]), (None, 2, [-5.0] * 3)]
    usable = [i for i, (_, l, v) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    f, n_links = Forest(), Counter()
    for a in usable:
        for b in usable:
            if a < b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = (np.array(rows[i][2], np.float32).astype(np.float64) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    n_links[a] += 1
                    n_links[b] += 1
                    f.join(a, b)
    low = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            low[f.find(i)] = min(row[0], low.get(f.find(i), row[0]))
    want = Counter((row[0], n_links[i], low.get(f.find(i)), None if row[0] is None or low.get(f.find(i)) is None else row[0] == low[f.find(i)]) for i, row in enumerate(rows))
    assert sum(n_links.values()) > 100
    found = embed_join.near_duplicates(vectors(spark, rows), scratch, **options).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in found) == want


def test_labels_may_be_text(spark, scratch):
    rows = [(i, "ab"[i % 2], [1.0, i * 1e-3]) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    found = {x.vec_id: (x.n_links, x.component_id) for x in embed_join.near_duplicates(frame, scratch, cell=2, most_pivots=16).collect()}
    assert found == {i: (3, i % 2) for i in range(8)}


def test_no_embeddings(spark, scratch):
    assert embed_join.near_duplicates(vectors(spark, []), scratch).count() == 0


def test_components_of_paths_and_stars(spark, scratch):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = {r.node: r.root for r in components(frame, scratch).collect()}
    assert all(found[i] == 0 for i in range(301))
    assert all(found[1000 + i] == 1000 for i in range(200))


@pytest.mark.parametrize("whole", [0, 1 << 19])
def test_components_in_one_task_and_in_rounds(spark, scratch, whole):
    r = random.Random(5)
    edges = [(r.randrange(-400, 400) << 40, r.randrange(-400, 400) << 40) for _ in range(500)] + [(7 << 50, 7 << 50)]
    f = Forest()
    for a, b in edges:
        f.join(a, b)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = components(frame, scratch, whole=whole).collect()
    assert Counter((x.node, x.root) for x in rows) == Counter((x, f.find(x)) for x in {e for a, b in edges if a != b for e in (a, b)})
    assert components(frame.filter("a > b and a < b"), scratch, "none", whole=whole).count() == 0


def test_small_tables_take_few_files(spark, docs, scratch):
    rows = near_texts()
    held = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = simhash.simhash_groups(docs(rows), scratch).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert Counter((x.doc_id, x.component_id) for x in found) == Counter((i, c) for (i, _), c in zip(rows, expected_components(rows, fps), strict=True))
    files = Counter(x.parent.name for x in Path(scratch.root.removeprefix("file://")).glob("*/part-*"))
    assert files.pop("fingerprints") <= 3
    assert set(files.values()) == {1} and len(files) == 3

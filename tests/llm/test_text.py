"""Language ID, decontamination, language-model scoring and packing against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontam, langid, lm, packing

CLASH = ("score", "lang_pred", "n_words", "spans", "items", "bucket", "text_key", "held_out", "block", "token")


def table(spark, **cols):
    n = len(next(iter(cols.values())))
    made = {k: pa.array(v, pa.int64() if k.endswith("_id") else pa.string()) for k, v in cols.items()}
    return spark.createDataFrame(pa.table(made | {c: pa.array(["own"] * n) for c in CLASH})).repartition(3)


# --- language ID ----------------------------------------------------------------------------------------------


def plain_grams(text):
    """All n-grams with zeros at word edges, by definition."""
    points = [0, *[ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""], 0]
    out = Counter()
    for k in (1, 2, 3):
        for i in range(len(points) - k + 1):
            g = points[i : i + k]
            if (k == 1 and g[0]) or (k == 2 and any(g)) or (k == 3 and g[1]):
                h = k
                for x in g:
                    h = ((h ^ x) * 0x01000193) % (1 << 32)
                    h ^= h >> 15
                out[((h * 0x9E3779B1) % (1 << 32) >> 16) % langid.BUCKETS] += 1
    return out


def speech(seed, n):
    r = random.Random(seed)
    tongues = {"aa": "aeiou bdg", "bb": "xyz kqw", "cc": "éüß mnø"}
    rows = []
    for i in range(n):
        lang = r.choice(list(tongues))
        rows.append((i, "".join(r.choice(tongues[lang]) for _ in range(r.randint(30, 200))), lang if r.random() < 0.9 else None))
    return rows


def test_language_id_equals_plain_bayes(spark):
    rows = speech(1, 120)
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "123 !!! ✓", "bb"), (203, rows[0][1], "aa"), (203, rows[0][1], "aa"), (None, "aeiou", "aa"), (205, "Äß İ 𝐀𝐁 𠀀", None), (206, ("aeiou bdg " * 60_000), None), (207, "x" * 300_000 + "é" * 300_000, None)]
    df = table(spark, doc_id=[r[0] for r in rows], text=[r[1] for r in rows], lang=[r[2] for r in rows])
    found = langid.predicted(df.withColumn("held_out", langid.held_out(F.col("doc_id"))), langid.fitted(df), ["doc_id", "held_out"]).collect()
    counts = {}
    for i, text, lang in rows:
        if lang and text is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    logs = {k: {b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b in range(langid.BUCKETS)} for k, c in counts.items()}
    want = {}
    for i, text, _ in rows:
        grams = plain_grams(text)
        if grams:
            total = {k: sum(n * v[b] for b, n in grams.items()) for k, v in logs.items()}
            best = max(total, key=total.get)
            want[i] = (best, 1 / sum(math.exp(x - total[best]) for x in total.values()))
        else:
            want[i] = ("und", 0.0)
    for r in found:
        if r.doc_id in want:
            assert r.lang_pred == want[r.doc_id][0]
            assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(found) == len(rows)


def test_long_texts_have_the_ngrams_of_short_ones(monkeypatch):
    text = "ab é " * 30 + "x" * 1000 + "\n\n" + "y1" * 200
    monkeypatch.setattr(langid, "_PIECE", 64)
    found = Counter()
    for _, _, points, skip in langid._pieces(pa.array([text, "ab", None, "z" * 65])):
        found.update(langid.features(points, skip)[0].tolist())
    want = Counter()
    for t in (text, "ab", None, "z" * 65):
        want.update(plain_grams(t))
    assert found == want


def test_language_id_held_out_accuracy(spark):
    rows = [r for r in speech(2, 400) if r[2]]
    df = table(spark, doc_id=[r[0] for r in rows], text=[r[1] for r in rows], lang=[r[2] for r in rows])
    found = langid.predicted(df.withColumn("held_out", langid.held_out(F.col("doc_id"))), langid.fitted(df), ["doc_id", "held_out"]).filter("held_out").collect()
    truth = {r[0]: r[2] for r in rows}
    assert found and sum(truth[r.doc_id] == r.lang_pred for r in found) / len(found) >= 0.98


def test_accepted_keeps_columns_and_clean_texts(spark):
    rows = speech(3, 60) + [(100, None, "aa"), (101, "12 34", "aa")]
    df = table(spark, doc_id=[r[0] for r in rows], text=[r[1] for r in rows], lang=[r[2] for r in rows])
    kept = langid.accepted(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60))


def test_language_id_without_labels(spark):
    df = table(spark, doc_id=[1, 2], text=["abc", None], lang=[None, None])
    assert [(r.lang_pred, r.score) for r in langid.predicted(df, langid.fitted(df), ["doc_id"]).collect()] == [("und", 0.0)] * 2
    assert langid.accepted(df.limit(0)).count() == 0


def test_language_sample_is_bounded(spark):
    rows = speech(5, 300)
    df = table(spark, doc_id=[r[0] for r in rows], text=[r[1] for r in rows], lang=[r[2] for r in rows])
    langs, matrix = langid.fitted(df, most=20)
    assert langs == ["aa", "bb", "cc"] and matrix.shape == (3, langid.BUCKETS)
    with pytest.raises(ValueError):
        langid.train(df.filter("lang is not null").select("text", "lang", F.col("doc_id").alias("key")), most_langs=2)


# --- decontamination ------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def plain_overlaps(docs, items, window=13):
    out = []
    for i, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for name, item in items:
            x = plain_words(item)
            k = min(window, len(x))
            for s in range(len(x) - k + 1) if x else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit.update(range(p, p + k))
                        names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def contaminated(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünd", "été", "X9"]

    def words(n):
        return [r.choice(vocabulary) for _ in range(n)]

    items = [(i, words(r.choice([1, 2, 5, 8, 12, 13, 14, 30, 60]))) for i in range(25)]
    items[3] = (3, items[2][1])
    docs = []
    for i in range(80):
        own = words(r.randint(0, 120))
        if r.random() < 0.6:
            _, item = r.choice(items)
            a = r.randint(0, max(0, len(item) - 13))
            b = a + r.choice([12, 13, 20])
            own[r.randint(0, len(own)) : 0] = item[a:b]
        docs.append((i, r.choice([" ", "\n", ", ", "-"]).join(own).replace("w1", "W1")))
    docs += [(90, None), (91, ""), (92, "?!"), (93, docs[0][1]), (93, docs[0][1]), (None, docs[1][1])]
    items = [(n, " ".join(x)) for n, x in items] + [(50, None), (51, "..."), (None, " ".join(words(20)))]
    return docs, items


@pytest.mark.parametrize(("seed", "bits"), [(1, 1 << 24), (2, 128)])
def test_overlaps(spark, seed, bits):
    docs, items = contaminated(seed)
    d = table(spark, doc_id=[x[0] for x in docs], text=[x[1] for x in docs])
    b = table(spark, item_id=[x[0] for x in items], text=[x[1] for x in items])
    found = decontam.overlaps(d, b, bits=bits).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in found) == Counter(plain_overlaps(docs, items))
    kept = decontam.clean(d, b, bits=bits)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for (i, t), x in zip(docs, plain_overlaps(docs, items), strict=True) if not x[4])


def test_overlaps_of_empty_tables(spark):
    docs, items = contaminated(3)
    d = table(spark, doc_id=[x[0] for x in docs], text=[x[1] for x in docs])
    b = table(spark, item_id=[x[0] for x in items], text=[x[1] for x in items])
    assert decontam.overlaps(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 for r in decontam.overlaps(d, b.limit(0)).collect())


def test_every_shared_window_has_a_fingerprint():
    r = random.Random(7)
    shared = [f"s{i}" for i in range(13)]
    for _ in range(50):
        text = " ".join([f"a{r.randint(0, 9)}" for _ in range(r.randint(0, 40))] + shared + [f"b{r.randint(0, 9)}" for _ in range(r.randint(0, 40))])
        raw = np.frombuffer(text.encode(), np.uint8)
        item = np.frombuffer(("zz " + " ".join(shared) + " yy").encode(), np.uint8)
        words, own = (decontam.Words(np.array([0, len(x)]), x, decontam.Rolling(1000)) for x in (raw, item))
        assert set(words.prints(13, 8)[1].tolist()) & set(own.prints(13, 8)[1].tolist())


def test_repetitive_texts_are_extended_once(spark):
    cycle = " ".join(f"c{i % 14}" for i in range(20_000))
    same = "a " * 20_000
    d = table(spark, doc_id=[1, 2, 3], text=[cycle, same, "x " + cycle[:3000] + " y"])
    b = table(spark, item_id=[1, 2], text=[cycle, same])
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.overlaps(d, b).collect()}
    n = len(cycle[:3000].split())
    assert found[1] == (20_000, 20_000, ["1"]) and found[2] == (20_000, 20_000, ["2"])
    assert found[3][0] == n + 2 and n - 1 <= found[3][1] <= n and found[3][2] == ["1"]


# --- language-model scoring -----------------------------------------------------------------------------------


def all_segmentations(text, pieces, byte_scores):
    """Log of the sum over every way to write a text as pieces and as single characters in bytes."""
    s, total = lm.MARK + text, []
    for cut in range(1 << (len(s) - 1)):
        ends = [i + 1 for i in range(len(s) - 1) if cut >> i & 1] + [len(s)]
        options, at = [[]], 0
        for e in ends:
            part, at = s[at:e], e
            found = []
            if part in pieces:
                found.append(pieces[part])
            if len(part) == 1:
                found.append(sum(byte_scores[b] for b in part.encode()))
            options = [o + [f] for o in options for f in found]
        total += [math.fsum(o) for o in options]
    top = max(total)
    return top + math.log(sum(math.exp(t - top) for t in total))


def test_lattice_sums_all_segmentations():
    pieces = {"▁a": -1.0, "▁ab": -2.0, "b": -1.5, "bc": -2.5, "c": -2.0, "abc": -4.0, "é": -3.0, "▁": -2.2}
    byte_scores = [-6.0 - b / 256 for b in range(256)]
    lattice = lm.Lattice(pieces, byte_scores)
    for word in ["a", "ab", "abc", "abcabc", "é", "xé", "zzz", "bcabé"]:
        assert lattice.word(word) == pytest.approx(all_segmentations(word, pieces, byte_scores), abs=1e-9)


def test_likelihoods(spark, scratch):
    if not Path(lm.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    import sentencepiece

    r = random.Random(2)
    words = ["the", "The", "nation", "été", "x", "zweifel", "hhhh", "9", "a-b"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "\t \n"), (103, docs[0][1]), (103, docs[0][1]), (None, "the end"), (105, "unseen token " + "q" * 3000)]
    d = table(spark, doc_id=[x[0] for x in docs], text=[x[1] for x in docs])
    found = lm.likelihoods(d, scratch, block=400).collect()

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    count = Counter(w for i, t in docs if not out(i) for w in lm.words(t))
    n_docs = sum(not out(i) for i, _ in docs)
    n, v = sum(count.values()) + n_docs, len(count) + 1
    data = Path(lm.VOCABULARY).read_bytes()
    names, byte_ids = lm.vocabulary(data)
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = Counter()
    for w, c in count.items():
        for p in model.encode(w.decode()):
            pieces[p] += c
    usable = [i for i, x in enumerate(names) if x] + byte_ids
    total = sum(pieces[i] + 0.5 for i in usable) + n_docs + 0.5
    scores = {i: math.log((pieces[i] + 0.5) / total) for i in usable}
    lattice = lm.Lattice({names[i]: scores[i] for i in usable if names[i]}, [scores[i] for i in byte_ids])
    end = math.log((n_docs + 0.5) / total)
    want = Counter()
    for i, t in docs:
        w = lm.words(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((n_docs + 0.5) / (n + 0.5 * (v + 1)))
        score = (sum(lattice.word(x.decode()) for x in w) + end) / math.log(10)
        want[i, out(i), len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(base, 6), round(score, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert got == want
    assert lm.likelihoods(d.limit(0), scratch).count() == 0


def test_model_beats_the_base_on_unseen_words(spark, scratch):
    if not Path(lm.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    words = [a + b for a in ("the", "nation", "in", "hand") for b in ("ing", "er", "s", "ed", "ly")]
    docs = [(i, " ".join(words[(i * 7 + k) % 17] for k in range(30))) for i in range(40)]
    found = lm.likelihoods(table(spark, doc_id=[x[0] for x in docs], text=[x[1] for x in docs]), scratch).collect()
    assert all(r.score < 0 and r.base_score < 0 for r in found)


# --- packing --------------------------------------------------------------------------------------------------


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 40), r.randint(1, 9)))
        counts = [r.randint(1, 20) for _ in lengths]
        k = r.randint(1, 5)
        ends = packing.best_boundaries(np.array(lengths), np.array(counts), k)
        assert ends == sorted(set(ends)) and ends[-1] == lengths[-1] and len(ends) <= k
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for j in range(min(k, len(lengths))) for c in combinations(lengths[:-1], j))
        assert padding(lengths, counts, ends) == best


@pytest.mark.parametrize("chunk", [8_000_000, 400])
def test_packing(spark, scratch, chunk):
    if not Path(packing.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    import tiktoken

    r = random.Random(5)
    words = ["w", "The", "été", "\n", "🙂", "<|endoftext|>", "zzzzqqq"]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 9, 30, 64, 65, 200, 900])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n"), (203, docs[7][1]), (203, docs[7][1]), (None, "a b"), (204, "x" * 200_000)]
    d = table(spark, doc_id=[x[0] for x in docs], text=[x[1] for x in docs])
    found = packing.pack_documents(d, scratch, max_tokens=64, batch_tokens=256, buckets=4, chunk=chunk).collect()
    vocabulary = Path(packing.VOCABULARY).read_bytes()
    ranks = {packing.base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoder = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = {t: len(encoder.encode_ordinary(t)) + 1 for t in {t or "" for _, t in docs} if len(t) < 65536}
    want = Counter((i, s, min(64, n - 64 * s)) for i, t in docs if len(t or "") < 65536 for n in [lengths[t or ""]] for s in range(-(-n // 64)))
    assert Counter((x.doc_id, x.segment, x.n_tokens) for x in found if x.doc_id != 204) == want
    assert all(x.start_token == 64 * x.segment and x.n_tokens == len(x.tokens) <= x.bucket_tokens for x in found)
    whole = {}
    for x in sorted(found, key=lambda x: x.segment):
        if x.doc_id != 203:
            whole[x.doc_id] = whole.get(x.doc_id, []) + x.tokens
    assert {i: packing.decoded(v, vocabulary).decode() for i, v in whole.items()} == {i: t or "" for i, t in docs if i != 203}
    assert all(v[-1] == 50_256 and v.count(50_256) == 1 for v in whole.values())
    lengths = sorted({x.n_tokens for x in found})
    counts = [sum(x.n_tokens == n for x in found) for n in lengths]
    ends = packing.best_boundaries(np.array(lengths), np.array(counts), 4)
    assert all(x.bucket_tokens == min(e for e in ends if e >= x.n_tokens) and ends[x.bucket] == x.bucket_tokens for x in found)
    for bucket in {x.bucket for x in found}:
        own = [x for x in found if x.bucket == bucket]
        most = max(1, 256 // own[0].bucket_tokens)
        places = sorted(x.batch * most + x.slot for x in own)
        assert places == list(range(len(own))) and all(x.slot < most for x in own)
    assert packing.pack_documents(d.limit(0), scratch).count() == 0


def test_tokens_of_a_long_text_are_held_in_parts(spark, monkeypatch):
    if not Path(packing.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    import tracemalloc

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choices(words, k=500_000))
    vocabulary = Path(packing.VOCABULARY).read_bytes()
    docs = spark.createDataFrame([(7, "")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)  # what a task does, run here
    run = packing.sequences(docs, vocabulary)
    list(run(iter([pa.record_batch({"doc_id": pa.array([0]), "text": pa.array(["a"])})])))  # reads the vocabulary
    tracemalloc.start()
    n = most = 0
    for batch in run(iter([pa.record_batch({"doc_id": pa.array([7]), "text": pa.array([text])})])):
        assert batch.column("start_token").to_pylist() == list(range(n, n + len(batch) * packing.MAX_TOKENS, packing.MAX_TOKENS))
        n, most = n + len(batch) * packing.MAX_TOKENS, max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert n > 1_500_000 and most < 8 * len(text)


def test_packed_keeps_columns_of_clashing_names(spark):
    seqs = spark.createDataFrame([(i, 0, 1 + i % 5, "own", "own") for i in range(30)], "doc_id long, segment long, n_tokens long, Slot string, batch string")
    found = packing.packed(seqs, buckets=2, max_tokens=8)
    assert set(found.columns) == {"doc_id", "segment", "n_tokens", "Slot_", "batch_", "bucket", "bucket_tokens", "batch", "slot"}
    assert all(x.Slot_ == x.batch_ == "own" for x in found.collect())

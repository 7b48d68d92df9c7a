"""Near copies of the pipeline and repeated ids, against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from weftline.llm import near_copies
from weftline.llm.common import Forest


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_kept(rows):
    f, sets = Forest(), [plain_shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                f.join(i, j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[f.find(i)] = min(k, low.get(f.find(i), k))
    return Counter(low.get(x) for x in {f.find(i) for i in range(len(rows))})


def edited_texts(seed):
    r = random.Random(seed)
    rows, boiler = [], [f"b{i}" for i in range(40)]
    for _ in range(30):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 40, 200, 900]))] + (boiler if r.random() < 0.4 else [])
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                own[r.randrange(len(own))] = f"w{r.randrange(400)}"
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    n = len(rows)
    return rows + [(n, None), (n + 1, " \t\n"), (n + 2, "One"), (n + 3, "one"), (None, "one"), (None, "zz yy"), (None, "zz yy")]


def sets(*texts):
    return list(near_copies.shingle_sets(pa.array(texts, pa.string())))


@pytest.mark.parametrize(("seed", "tile"), [(1, 8192), (2, 20), (3, 8192)])
def test_near_copies_are_all_found(spark, docs, scratch, seed, tile):
    rows = edited_texts(seed)
    found = near_copies.keep_one(docs(rows), scratch, tile=tile)
    assert found.columns == docs(rows).columns
    assert Counter(r.doc_id for r in found.collect()) == plain_kept(rows)


def test_alike_at_the_bound():
    words = [f"w{i}" for i in range(44)]  # 40 shingles
    a, b, c = sets(" ".join(words), " ".join(words[:36]), " ".join(words[:35]))
    assert near_copies.alike(a, b)  # 32 of 40
    assert not near_copies.alike(a, c)


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(5)
    texts = [" ".join("A" * r.randrange(1, 60) + str(r.randrange(50)) for _ in range(r.randrange(200))) for _ in range(60)] + [None, "", " ", "x" * 5000, "a b", "A  b\n"]
    whole = sets(*texts)
    for text, found in zip(texts, whole, strict=True):
        assert len(found) == len(plain_shingles(text))
    assert whole[-1].tolist() == whole[-2].tolist()
    monkeypatch.setattr(near_copies, "_PIECE", 700)
    cut = sets(*texts)
    assert [x.tolist() for i, x in enumerate(cut) if i != 63] == [x.tolist() for i, x in enumerate(whole) if i != 63]


def test_loss_of_fingerprints():
    """Pairs just at the bound: almost all within the radius."""
    r, lost, n = random.Random(3), 0, 300
    for _ in range(n):
        words = [f"w{r.randrange(10**6)}" for _ in range(304)]  # 300 shingles
        other = words[:271] + [f"v{r.randrange(10**6)}" for _ in range(33)]  # 267 of 333 in common
        a, b = sets(" ".join(words), " ".join(other))
        assert near_copies.alike(a, b)
        far = sum(int(x).bit_count() for x in (near_copies.fingerprint(a) ^ near_copies.fingerprint(b)).view("uint64"))
        lost += far > near_copies.RADIUS
    assert lost == 0


def test_stage_drops_near_copies(spark, docs, scratch):
    import corpus_pipeline

    r = random.Random(7)
    rows = []
    for i in range(20):
        words = [f"w{r.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for at in (50, 150, 250):
            words[at] = "other"
        rows.append((2 * i + 1, " ".join(words)))  # Jaccard 281 / 311
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect()}
    assert kept == set(range(0, 40, 2))


def test_no_near_copies(spark, docs, scratch):
    assert near_copies.keep_one(docs([]), scratch).count() == 0


def test_repeated_ids_of_unlike_texts(spark, docs, scratch):
    r = random.Random(9)
    one, two, three = (" ".join(f"w{r.randrange(5000)}" for _ in range(80)) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (7, three), (7, two), (8, one + " "), (7, three)]
    found = Counter((x.doc_id, x.text) for x in near_copies.keep_one(docs(rows), scratch).collect())
    assert found == Counter([(1, one), (5, two), (7, three)])


def test_repeated_rows_and_null_ids(spark, docs, scratch):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (3, text), (None, text), (None, "alone"), (None, "alone"), (4, "other words"), (4, "other words"), (9, None), (9, "")]
    found = Counter((x.doc_id, x.text or "") for x in near_copies.keep_one(docs(rows), scratch).collect())
    assert found == Counter([(3, text), (None, "alone"), (4, "other words"), (9, "")])

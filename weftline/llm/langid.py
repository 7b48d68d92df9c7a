"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftline.llm.common import bounded_batches, crc32_of, fresh

#: Lengths of the character n-grams and the number of hash buckets they share.
GRAMS = (1, 2, 3)
BUCKETS = 1 << 16
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Documents of each language that the model is fitted on, about; more are sampled by their hash.
TRAIN_ROWS = 4000
#: Languages that the broadcast matrix has room for, at 256 KB each.
MOST_LANGS = 200
#: Predictions of a smaller posterior are rejected by accepted().
MIN_SCORE = 0.5
UNKNOWN = "und"
#: Characters of texts that are scored at once.
_PIECE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Basic-plane code points to their lower-case letter, or to 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


def _folded(points: np.ndarray) -> np.ndarray:
    """Lower-case letters of code points; 0 elsewhere."""
    out = _letters()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        c = chr(points[i])
        out[i] = points[i] if c.isalpha() else 0
    return out


def features(points: np.ndarray, skip: int = 0, grams: tuple[int, ...] = GRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, 0 between words and texts -> (buckets, positions) of all n-grams that end at place
    `skip` or later. An n-gram has a letter, and zeros at its ends only; a run of zeros counts once, as a
    word's edge."""
    found, places = [], []
    for k in grams:
        n = len(points) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint32)
        inner = np.ones(n, bool)
        for i in range(k):
            part = points[i : i + n]
            h = (h ^ part) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            if k == 1 or 0 < i < k - 1:
                inner &= part != 0
        if k == 2:
            inner &= (points[:n] != 0) | (points[1 : 1 + n] != 0)
        inner[: max(0, skip - k + 1)] = False
        at = np.flatnonzero(inner)
        found.append(((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % buckets)
        places.append(at)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def _pieces(array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, row of each position, folded code points, places that came before) of consecutive rows, about
    _PIECE characters at a time. Each text has a 0 on both sides. A longer text comes in several pieces, each
    with the last places of the one before, so that its n-grams are those of the whole text."""
    rows, size, first = [], 0, 0

    def packed(parts):
        points = _folded(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32))
        return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), points

    for i, text in enumerate(array.to_pylist()):
        text = f"\0{text or ''}\0"
        if len(text) > _PIECE:
            if rows:
                yield first, *packed(rows), 0
            for at in range(0, len(text), _PIECE):
                before = min(at, max(GRAMS) - 1)
                yield i, *packed([text[at - before : at + _PIECE]]), before
            rows, size, first = [], 0, i + 1
            continue
        rows.append(text)
        size += len(text)
        if size > _PIECE:
            yield first, *packed(rows), 0
            rows, size, first = [], 0, i + 1
    if rows:
        yield first, *packed(rows), 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for first, rows, points, skip in _pieces(batch.column("text")):
            bucket, at = features(points, skip)
            row = rows[at] + first
            for lang in set(langs[first : first + int(rows[-1]) + 1]):
                own = bucket[(langs == lang)[row]]
                sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int64), "n": n[at].astype(np.int64)})


def train(labelled: DataFrame, most: int = TRAIN_ROWS, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray]:
    """Rows (text, lang, key), lang not null -> (languages, log probabilities by language and bucket).

    A language of more than `most` rows is sampled by the hash of the key, to about that many: the bound
    of the sample. More than most_langs languages are refused, as the matrix is broadcast; so what is
    collected is bounded too. Languages have equal prior weight."""
    bounded_batches(labelled.sparkSession)
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted(sizes)
    table = np.full((max(1, len(langs)), BUCKETS), SMOOTHING)
    if langs:
        share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, most / sizes[lang]))])
        chosen = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))
        found = chosen.select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        for i, lang in enumerate(langs):
            own = found[found["lang"] == lang]
            table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Rows with a text -> their columns `keep`, and those called `to`: language and score. The matrix is broadcast; a
    task sums its rows over each text's n-grams, of long texts piece by piece. score is the posterior of the
    predicted language; of equal ones the first in the alphabet is told. Null texts, texts without a
    letter, and all texts under a model without languages give UNKNOWN and 0. Repeated rows are each
    predicted; an empty table stays empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    langs, table = model
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            total, seen = np.zeros((n, len(weights))), np.zeros(n, np.int64)
            for first, rows, points, skip in _pieces(batch.column("text")):
                bucket, at = features(points, skip)
                row, m = rows[at], int(rows[-1]) + 1
                for j, weight in enumerate(weights):
                    total[first : first + m, j] += np.bincount(row, weight[bucket], m)
                seen[first : first + m] += np.bincount(row, minlength=m)
            best = total.argmax(axis=1)
            post = np.exp(total - total.max(axis=1, keepdims=True))
            score = post.max(axis=1) / post.sum(axis=1)
            none = (seen == 0) | (len(langs) == 0)
            best[none], score[none] = len(langs), 0.0
            cols = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {to[0]: pa.array(names[best], pa.string()), to[1]: score})

    schema = StructType([*[docs.schema[c] for c in keep], StructField(to[0], StringType()), StructField(to[1], DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(crc32_of(id_col) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """The model of the rows that are not held out; text and lang are all it sees of them."""
    return train(docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.col("doc_id").alias("key")), most)


def accepted(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is told: rejected are those without a letter and those whose
    posterior is below min_score. Columns stay as they are, whatever their names; repeated rows stay or
    go together; an empty table stays empty."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    kept = predicted(docs, fitted(docs), docs.columns, (lang, score)).filter((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score))
    return kept.select(*docs.columns)

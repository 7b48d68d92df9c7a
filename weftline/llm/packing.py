"""Packing of token sequences into batches by optimal length buckets."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, cleared, fresh

#: Byte-level BPE ranks, and the pattern that splits texts before the merges (fixed, it belongs to the ranks).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Longest sequence; longer documents become several.
MAX_TOKENS = 2048
#: Number of length buckets and padded tokens of a batch.
BUCKETS = 12
BATCH_TOKENS = 32_768
#: Padded tokens of a bucket's sequences that are numbered together, about.
CHUNK = 8_000_000
#: Tasks that number chunks, at most; with more chunks, a task has several.
TASKS = 50_000
SEED = 11
_PIECE = 1 << 16
#: Tokens that leave a task at once, about.
_HELD = 1 << 20


@cache
def _encoder(vocabulary: bytes, pattern: str) -> Callable[[str], Iterator[np.ndarray]]:
    """Text to the ids of its tokens and one end, the id after the last; once for each worker. Texts are read in pieces of
    _PIECE characters, each with tokens of its own; a piece's ids come at once, the end with the last one's."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    end = max(ranks.values()) + 1

    def encode(text: str) -> Iterator[np.ndarray]:
        for i in range(0, max(1, len(text)), _PIECE):
            ids = encoding.encode_ordinary(text[i : i + _PIECE])
            if i + _PIECE >= len(text):
                ids.append(end)
            yield np.array(ids, np.int32)

    return encode


def decoded(tokens: list[int], vocabulary: bytes) -> bytes:
    """The bytes that token ids stand for; ends stand for none."""
    pieces = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return b"".join(pieces.get(i, b"") for i in tokens)


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper ends of at most k buckets over a histogram of ascending lengths, such that padding each
    sequence to its bucket's end adds the fewest tokens. Exact dynamic programming over (bucket, length),
    O(k n^2) in numpy; of equal costs, the one with the smaller ends."""
    n = len(lengths)
    if n == 0:
        return []
    lengths = lengths.astype(np.int64)
    c = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    cost = lengths * c[1:]  # one bucket up to i: padded tokens; their sum minus a constant is the padding
    back = []
    for _ in range(1, min(k, n)):
        after, cut = cost.copy(), np.full(n, -1)
        for i in range(1, n):
            # last bucket has lengths j+1..i
            total = cost[:i] + lengths[i] * (c[i + 1] - c[1 : i + 1])
            j = int(total.argmin())
            if total[j] < after[i]:
                after[i], cut[i] = total[j], j
        back.append(cut)
        cost = after
    ends, i = [], n - 1
    for cut in reversed(back):
        if i < 0 or cut[i] < 0:
            continue
        ends.append(i)
        i = int(cut[i])
    ends.append(i)
    return [int(lengths[x]) for x in reversed(ends)]


def sequences(docs: DataFrame, vocabulary: bytes, max_tokens: int = MAX_TOKENS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and text -> doc_id, segment, start_token, n_tokens, tokens: the ids of a whole text's tokens and one end, a
    row for each max_tokens of them and the rest. The ids of a document in order decode to its bytes. Of a text's ids a
    task holds about _HELD at once, as 4 bytes each, however long the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern)
        for batch in batches:
            rows, parts, held = [], [], 0
            for i, text in enumerate(batch.column("text")):
                at, open_ = 0, np.zeros(0, np.int32)  # ids that have left the text's open sequence, and those in it
                for ids in encode(text.as_py() or ""):
                    open_ = np.concatenate([open_, ids])
                    while len(open_) >= max_tokens:
                        rows.append((i, at // max_tokens, at, max_tokens))
                        parts.append(open_[:max_tokens])
                        at, open_, held = at + max_tokens, open_[max_tokens:], held + max_tokens
                    if held > _HELD:
                        yield made(batch, rows, parts)
                        rows, parts, held = [], [], 0
                if len(open_):
                    rows.append((i, at // max_tokens, at, len(open_)))
                    parts.append(open_)
                    held += len(open_)
            if rows:
                yield made(batch, rows, parts)

    def made(batch, rows, parts):
        at, segment, start, n = np.array(rows, np.int64).T
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(at)), "segment": segment, "start_token": start, "n_tokens": n, "tokens": tokens})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, segment long, start_token long, n_tokens long, tokens array<int>")


def packed(seqs: DataFrame, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, max_tokens: int = MAX_TOKENS, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Sequences with doc_id, segment and n_tokens (1..max_tokens) -> the same rows with bucket, bucket_tokens (the
    length all of the bucket are padded to), batch (gapless from 0 within the bucket) and slot (gapless from 0
    within the batch). A batch holds as many sequences as its token budget fits at the padded length, one at
    least; the last of a bucket may be smaller. Other columns go along, those of the new names under
    theirs and an underscore.

    The histogram is global and has max_tokens rows at most, so it may be collected. A bucket's rows are
    dealt by hash into chunks of so many tokens, numbered within each chunk and offset by the sizes of the
    chunks before, so that no task holds a bucket. Rows equal in all hashed columns are numbered in any
    order, and lie in one chunk."""
    seqs = cleared(seqs, "bucket", "bucket_tokens", "batch", "slot")
    histogram = seqs.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").limit(max_tokens + 1).toPandas()
    ends = best_boundaries(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    if not ends:
        ends = [1]
    sizes = [int(histogram["n"][(histogram["n_tokens"] <= e) & (histogram["n_tokens"] > b)].sum()) for b, e in zip([0, *ends], ends, strict=False)]
    spread = [max(1, -(-s * e // chunk)) for s, e in zip(sizes, ends, strict=True)]
    own, part, at, before = (fresh(seqs, x) for x in ("__row", "__chunk", "__at", "__before"))

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(x).cast("long") for x in values]), F.col("bucket") + 1)

    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], i).otherwise(bucket)
    row = F.xxhash64(F.lit(seed), "doc_id", "segment")
    dealt = seqs.withColumn("bucket", bucket).withColumn("bucket_tokens", by_bucket(ends)).withColumn(own, row).withColumn(part, F.pmod(own, by_bucket(spread)))
    shares = dealt.select("bucket", part)
    dealt = dealt.repartition(min(TASKS, sum(spread)), "bucket", part)  # else the session's number of partitions bounds it
    number = F.row_number().over(Window.partitionBy("bucket", part).orderBy(own, "doc_id", "segment", "n_tokens")) - 1
    numbered = dealt.withColumn(at, number.cast("long"))
    ahead = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    chunks = shares.groupBy("bucket", part).agg(F.count("*").alias("n")).select("bucket", part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    placed = numbered.join(chunks, ["bucket", part]).withColumn(at, F.col(at) + F.col(before))
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("bucket_tokens")))
    return placed.withColumn("batch", F.floor(F.col(at) / most)).withColumn("slot", F.pmod(at, most)).drop(own, part, at, before)


def pack_documents(docs: DataFrame, scratch: Scratch, path: str = VOCABULARY, **options: int) -> DataFrame:
    """doc_id, segment, start_token, n_tokens, tokens, bucket, bucket_tokens, batch, slot of all documents. Null and
    empty texts are one end token. Repeated rows are packed each; null ids are kept; an empty table gives
    no rows; other columns are not read."""
    vocabulary = Path(path).read_bytes()  # by the driver; executors get it with the task
    seqs = sequences(docs, vocabulary, options.get("max_tokens", MAX_TOKENS))
    found = packed(scratch.keep(seqs, "sequences"), **options)
    return found.select("doc_id", "segment", "start_token", "n_tokens", "tokens", "bucket", "bucket_tokens", "batch", "slot")

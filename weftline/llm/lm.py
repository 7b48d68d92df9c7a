"""Language-model scoring: marginal likelihood of texts over all segmentations into vocabulary pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, crc32_of, release

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of texts that are scored against one block's dictionary.
BLOCK = 16 << 20
SMOOTHING = 0.5
#: The mark before each word in the vocabulary.
MARK = "▁"
#: Distinct tokens whose lattices are summed in one task, about.
TOKENS = 50_000


class Lattice:
    """Log probability of a word, summed over all its segmentations into pieces and single bytes."""

    def __init__(self, pieces: dict[str, float], byte_scores: list[float]):
        """pieces: natural log probabilities; byte_scores: those of the 256 bytes, which make every
        word expressible."""
        self.pieces, self.bytes = pieces, byte_scores
        self.single: dict[str, float] = {}  # scores of characters as bytes
        self.longest = max(map(len, pieces), default=1)

    def word(self, word: str) -> float:
        """Forward recursion in log space: alpha[i] of the first i characters adds up, over all pieces
        that end there, alpha before the piece plus the piece's score."""
        s = MARK + word
        get, single, longest, exp, log = self.pieces.get, self.single, self.longest, math.exp, math.log
        alpha = [0.0]
        for i in range(1, len(s) + 1):
            c = s[i - 1]
            if c not in single:
                single[c] = sum(self.bytes[b] for b in c.encode("utf-8", "surrogatepass"))
            terms = [alpha[i - 1] + single[c]]
            for j in range(i - longest if i > longest else 0, i):
                score = get(s[j:i])
                if score is not None:
                    terms.append(alpha[j] + score)
            top = max(terms)
            total = 0.0
            for t in terms:
                total += exp(t - top)
            alpha.append(top + log(total))
        return alpha[-1]


def vocabulary(data: bytes) -> tuple[list[str], list[int]]:
    """(pieces in the order of their ids, ids of the 256 single bytes) of an existing SentencePiece
    vocabulary; control and unknown pieces are empty strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names, at = [], [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            at[int(piece[3:5], 16)] = i
        names.append("" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else piece)
    return names, at


def held_out(id_col: Column) -> Column:
    return F.coalesce(crc32_of(id_col) % 5 == 1, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """Runs of characters that are no ASCII white space, A-Z lowered, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block -> (block, token, n: times in training texts) once for each distinct token."""
    now, kept, others = None, Counter(), set()

    def rows(block):
        found = [*kept, *(others - kept.keys())]
        n = [*kept.values(), *[0] * (len(found) - len(kept))]
        return pa.record_batch({"block": pa.array([block] * len(found), pa.int64()), "token": pa.array(found, pa.binary()), "n": pa.array(n, pa.int64())})

    for batch in batches:
        for block, out, text in zip(*(batch.column(c).to_pylist() for c in ("block", "held_out", "text")), strict=True):
            if block != now:
                if now is not None:
                    yield rows(now)
                now, kept, others = block, Counter(), set()
            if out:
                others.update(words(text))
            else:
                kept.update(words(text))
    if now is not None:
        yield rows(now)


def _piece_counts(data: bytes):
    """(piece id, n): pieces in the vocabulary's own segmentation of training tokens, times the tokens' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in batch.column("token").to_pylist()]
            for ids, n in zip(model.encode(texts, num_threads=1), batch.column("c").to_pylist(), strict=True):
                for i in ids:
                    total[i] += n
        at = np.flatnonzero(total)
        yield pa.record_batch({"piece": at, "n": total[at]})

    return run


def _token_scores(lattice: Lattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lattice.word(x.decode("utf-8", "surrogatepass")) for x in batch.column("token").to_pylist()]
            yield pa.record_batch({"token": batch.column("token"), "c": batch.column("c"), "lp": pa.array(scores, pa.float64())})

    return run


def _scored(end: tuple[float, float, bool], base_of: tuple[float, float]):
    """Rows sorted by block, of each the dictionary (kind 0) before the texts -> their scores. end: base score, model
    score and whether known, of a text's end; base_of: (smoothing, log10 of the denominator). A task holds one
    block's dictionary and a batch of texts, however many rows a block has."""
    add, log_total = base_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, parts, told = None, {}, [], None

        def scores(texts):
            base, lp, known = told
            for text in texts:
                found = words(text)
                i = np.fromiter(map(at.__getitem__, found), np.int64, len(found))
                yield len(found) + 1, int(known[i].sum()) + end[2], float(base[i].sum()) + end[0], float(lp[i].sum()) + end[1]

        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = (np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist()
            for i, j in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if i == j:
                    continue
                rows = batch.slice(i, j - i)
                if block[i] != now:
                    now, at, parts, told = block[i], {}, [], None
                if not kind[i]:
                    at.update(zip(rows.column("token").to_pylist(), range(len(at), len(at) + j - i), strict=True))
                    parts.append((rows.column("c").to_numpy(), rows.column("lp").to_numpy()))
                    continue
                if told is None:
                    c, lp = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0))
                    told = np.log10(c + add) - log_total, lp / math.log(10), c > 0
                n, k, b, s = zip(*scores(rows.column("text").to_pylist()), strict=True)
                out = {"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(k, pa.int64())}
                yield pa.RecordBatch.from_pydict(out | {"base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64())})

    return run


def likelihoods(docs: DataFrame, scratch: Scratch, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model: a text is its words in order and an end; a word is any sequence of vocabulary pieces that
    spells it after the word mark, single bytes always among them; pieces and the end are drawn
    independently. A text's likelihood so is the product of its words' lattice sums, and each distinct
    token's is computed once. The vocabulary is given and never trained. Its own scores are the ranks of its
    merges, no logarithms of probabilities, and cannot weigh a segmentation; so the weights of its pieces are
    smoothed counts over the training texts, segmented as the vocabulary does it, and the lattice sums over
    all segmentations with these. A unigram vocabulary would bring its own weights; none is installed.

    Texts are dealt by hash into blocks of bounded size. A block contributes each distinct token once, so
    no token brings more rows to the counts and joins than there are blocks; the counts go back to each
    block as a dictionary of its own tokens. The piece table, of the vocabulary's size, is all that is
    collected. Null texts are empty: an end only. Without training texts all counts are 0. Repeated rows
    count and are scored each; equal ones are in one block, whose texts stream through its task. Texts are
    whole, however long; an empty table gives no rows."""
    spark = scratch.spark
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total, n_docs, trained = docs.agg(F.sum(size), F.count("*"), F.count_if(~held_out(F.col("doc_id")))).first()
    blocks = max(1, -(-(total or 0) // block))
    dealt = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    by_block = dealt.select("block", "held_out", "text").repartition("block").sortWithinPartitions("block")
    distinct = scratch.keep(by_block.mapInArrow(_block_words, "block long, token binary, n long"), "distinct")
    release(spark)
    counts = scratch.keep(distinct.groupBy("token").agg(F.sum("n").alias("c")), "counts")
    n, v = counts.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + trained, v + (trained > 0)

    data = Path(path).read_bytes()  # by the driver; executors get it with the task
    names, byte_ids = vocabulary(data)
    pieces = np.zeros(len(names) + 1)
    for r in counts.filter("c > 0").mapInArrow(_piece_counts(data), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        pieces[r.piece] = r.n
    pieces[-1] = trained  # the end
    usable = np.array([bool(x) for x in names] + [True])
    usable[byte_ids] = True
    scores = np.log(pieces + SMOOTHING) - math.log(float((pieces[usable] + SMOOTHING).sum()))
    lattice = Lattice({x: float(s) for x, s in zip(names, scores, strict=False) if x}, [float(scores[i]) for i in byte_ids])
    scored = scratch.keep(counts.repartition(max(1, -(-v // TOKENS))).mapInArrow(_token_scores(lattice), "token binary, c long, lp double"), "scored")

    scratch.drop("counts")
    log_total = math.log10(n + SMOOTHING * (v + 1))
    end = (math.log10(trained + SMOOTHING) - log_total, float(scores[-1]) / math.log(10), trained > 0)
    dictionaries = scratch.keep(distinct.select("block", "token").join(scored, "token"), "dictionaries")
    release(spark)
    scratch.drop("distinct", "scored")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    run = _scored(end, (SMOOTHING, log_total))
    own = dictionaries.select("block", F.lit(0).alias("kind"), "token", "c", "lp")
    both = own.unionByName(dealt.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    out = both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))

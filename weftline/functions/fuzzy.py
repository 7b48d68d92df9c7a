"""Fuzzy string ratios as Arrow UDFs, from the published definitions.

ratio is the indel similarity 2 * LCS / (|a| + |b|); partial_ratio the best ratio of the shorter text against a
window of the longer; token ratios compare sorted words or word sets. Pairs are scored once for each distinct
pair of a batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    best = max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))
    if n == len(long):  # either may be the window
        best = max(best, *(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def _set_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    return both, f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's own."""
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _set_parts(a, b)
    if both and (both == left or both == right):
        return 1.0
    found = [ratio(left, right)]
    if both:
        found += [ratio(both, left), ratio(both, right)]
    return max(found)


def partial_token_ratio(a: str, b: str) -> float:
    if set(a.split()) & set(b.split()):
        return 1.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(sorted(set(a.split()))), " ".join(sorted(set(b.split())))))


def weighted_ratio(a: str, b: str) -> float:
    """Best of ratio and token ratios at 0.95; for lengths that differ by half or more, of partial ratios at 0.9, or
    0.6 beyond a factor of eight."""
    if not a or not b:
        return 0.0
    by = max(len(a), len(b)) / min(len(a), len(b))
    if by < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if by <= 8 else 0.6
    return max(ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def matching_blocks_ratio(a: str, b: str) -> float:
    import difflib

    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def tfidf_cosine(a: str, b: str) -> float:
    """Cosine of smoothed tf-idf vectors over words of two characters or more and their pairs, the two texts being
    the whole corpus."""

    def terms(text: str) -> Counter:
        w = re.findall(r"\b\w\w+\b", text.lower())
        return Counter(w) + Counter(f"{x} {y}" for x, y in zip(w, w[1:], strict=False))

    x, y = terms(a), terms(b)
    if not x or not y:
        return 0.0
    idf = {t: 1.0 if t in x and t in y else 1 + math.log(3 / 2) for t in x.keys() | y.keys()}
    norm = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in v.items())) for v in (x, y)]
    return sum(n * y[t] * idf[t] ** 2 for t, n in x.items() if t in y) / (norm[0] * norm[1])


def string_blend(a: str, b: str) -> float:
    """0.3 ratio, 0.3 token sort, 0.4 tf-idf cosine; the phonetic part is left out and the weights renormalised."""
    return 1.0 if a == b else 0.3 * ratio(a, b) + 0.3 * token_sort_ratio(a, b) + 0.4 * tfidf_cosine(a, b)


def name_blend(a: str, b: str) -> float:
    return 0.5 * token_set_ratio(a, b) + 0.5 * weighted_ratio(a, b)


def slice_blend(a: str, b: str) -> float:
    return 0.4 * ratio(a, b) + 0.4 * token_sort_ratio(a, b) + 0.2 * partial_ratio(a, b)


def best_ratio(a: str, b: str) -> float:
    return max(ratio(a, b), partial_ratio(a, b), token_set_ratio(a, b), token_sort_ratio(a, b))


def pair_udf(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """Two text columns -> score; an empty or null side gives 0."""

    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = lru_cache(maxsize=1 << 16)(score)
        for left, right in parts:
            yield pd.Series([known(a, b) if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")

    return lambda a, b: run(a.cast("string"), b.cast("string"))


ratio_udf = pair_udf(ratio)
partial_ratio_udf = pair_udf(partial_ratio)
token_sort_udf = pair_udf(token_sort_ratio)
token_set_udf = pair_udf(token_set_ratio)
weighted_ratio_udf = pair_udf(weighted_ratio)
matching_blocks_udf = pair_udf(matching_blocks_ratio)
tfidf_udf = pair_udf(tfidf_cosine)
string_blend_udf = pair_udf(string_blend)
name_blend_udf = pair_udf(name_blend)
slice_blend_udf = pair_udf(slice_blend)
best_ratio_udf = pair_udf(best_ratio)


def name_similarity(a: Column, b: Column) -> Column:
    """name_blend of fuzzy names."""
    from weftline.functions.normalize import fuzzy_name

    return name_blend_udf(fuzzy_name(a), fuzzy_name(b))


def address_tokens_similarity(a: Column, b: Column) -> Column:
    from weftline.functions.normalize import fuzzy_name

    return token_set_udf(fuzzy_name(a), fuzzy_name(b))


def phone_similarity(a: Column, b: Column) -> Column:
    """Equal 1, equal last seven digits 0.8, else ratio * 0.6."""
    from weftline.functions.normalize import phone

    x, y = phone(a), phone(b)
    same = (F.length(x) >= 7) & (F.length(y) >= 7) & (F.right(x, F.lit(7)) == F.right(y, F.lit(7)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(same, 0.8).otherwise(ratio_udf(x, y) * 0.6)

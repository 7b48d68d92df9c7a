"""Similarities in [0, 1] as native expressions; an empty side gives 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions import tokens as T
from weftline.functions.values import text


def guarded(a: Column, b: Column, score: Column) -> Column:
    return F.when((text(a) == "") | (text(b) == ""), 0.0).otherwise(score)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every > 0, common / every).otherwise(0.0)


def over_jaccard(a: Column, b: Column, least: float) -> Column:
    """Whether two arrays of distinct values have a Jaccard similarity over `least`, which sizes alone rule out for most."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (small > large * F.lit(least)) & (set_jaccard(a, b) > least)


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(T.characters(a), T.characters(b))


def place_jaccard(a: Column, b: Column, places: str = "市区县镇街道路号") -> Column:
    """Character Jaccard, times 1.2 (at most 1) where both share a place character."""
    shared = F.size(F.filter(F.array_intersect(T.characters(a), T.characters(b)), lambda c: F.lit(places).contains(c))) > 0
    base = char_jaccard(a, b)
    return F.when(shared, F.least(F.lit(1.0), base * 1.2)).otherwise(base)


#: What makes a place of a text.
STREETS, PLACES = "路街", ("路", "街", "号", "弄", "村", "镇", "院", "中心", "大厦", "广场")


def place_strategy(a: Column, b: Column, strategy: str = "fuzzy") -> Column:
    """Jaccard of letters and digits. "levels": times 1.2 where both have a street; "meaning": 0.4 of it and 0.6 of the
    Jaccard of place words where both have some."""
    base = set_jaccard(*(T.characters(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) for x in (a, b)))
    if strategy == "levels":
        return F.when(a.rlike(f"[{STREETS}]") & b.rlike(f"[{STREETS}]"), base * 1.2).otherwise(base)
    if strategy == "meaning":
        def places(x: Column) -> Column:
            return F.filter(F.array(*[F.lit(w) for w in PLACES]), lambda w: F.coalesce(x, F.lit("")).contains(w))

        left, right = places(a), places(b)
        return F.when((F.size(left) > 0) & (F.size(right) > 0), set_jaccard(left, right) * 0.6 + base * 0.4).otherwise(base)
    return base


#: Weights of an address by segments, and what equal parts add.
SEGMENTS = {"province": 0.2, "city": 0.3, "district": 0.3, "detail": 0.2}
KEY_PARTS, KEY_BONUS, BUILDING_BONUS, LIKE_BUILDINGS = ("number", "street", "district"), (0.0, 0.05, 0.1, 0.1), 0.05, 0.8


def segmented(a: Column, b: Column, score: Callable[[Column, Column], Column], weights: dict[str, float] = SEGMENTS) -> Column:
    """Of two structs of an address's segments: the weighted mean over segments that either side has."""
    value, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        x, y = (F.coalesce(side[name], F.lit("")) for side in (a, b))
        there = (x != "") | (y != "")
        value = value + F.when(there, score(x, y) * w).otherwise(0.0)
        weight = weight + F.when(there, w).otherwise(0.0)
    return F.when(weight > 0, value / weight).otherwise(0.0)


def part_bonus(a: Column, b: Column, score: Callable[[Column, Column], Column]) -> Column:
    """Of two structs of an address's parts: what equal key parts and like buildings add to a score."""
    def part(side: Column, name: str) -> Column:
        return F.coalesce(F.trim(side[name]), F.lit(""))

    equal = sum(((part(a, k) != "") & (part(a, k) == part(b, k))).cast("int") for k in KEY_PARTS)
    bonus = F.element_at(F.array(*[F.lit(x) for x in KEY_BONUS]), equal + 1)
    x, y = part(a, "building"), part(b, "building")
    return bonus + F.when((x != "") & (y != "") & (score(x, y) > LIKE_BUILDINGS), BUILDING_BONUS).otherwise(0.0)


def keyword_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(T.street_terms(a), T.street_terms(b))


def weighted_keyword_jaccard(a: Column, b: Column) -> Column:
    """Sum of the smaller weights over the sum of the larger ones, over the keywords of both addresses."""
    left, right = T.weighted_address_keywords(a), T.weighted_address_keywords(b)
    both = F.map_zip_with(left, right, lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("low"), F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("high")))
    values = F.map_values(both)
    low = F.aggregate(values, F.lit(0.0), lambda s, v: s + v["low"])
    high = F.aggregate(values, F.lit(0.0), lambda s, v: s + v["high"])
    return F.when(high > 0, low / high).otherwise(0.0)


def levenshtein(a: Column, b: Column) -> Column:
    """Equal 1; one within the other 0.8; else 1 - distance / longer length."""
    n = F.greatest(F.length(a), F.length(b))
    score = F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise((n - F.levenshtein(a, b)) / n)
    return guarded(a, b, score)


def containment(a: Column, b: Column) -> Column:
    """Equal 1, one within the other 0.8, else character Jaccard."""
    return guarded(a, b, F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(char_jaccard(a, b)))


def exact_or_contained(a: Column, b: Column) -> Column:
    """Equal 1, one within the other 0.7, else 0, without regard to case."""
    x, y = F.lower(text(a)), F.lower(text(b))
    return guarded(a, b, F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).otherwise(0.0))


def longest_common_subsequence(a: Column, b: Column) -> Column:
    """Its length, by a row of the dynamic program for each character of a."""
    other = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(before: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            best = F.when(F.element_at(other, j) == c, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(done, -1)))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), start, row), -1)).otherwise(0)


def lcs_share(a: Column, b: Column) -> Column:
    return guarded(a, b, longest_common_subsequence(a, b) / F.greatest(F.length(a), F.length(b)))


def numeric(a: Column, b: Column, tolerance: float = 0.1, zero_counts: bool = True) -> Column:
    """Within the tolerance 1 falling to 0.8, beyond it 1 - relative difference. zero_counts: nulls are 0 and
    one 0 differs by all; otherwise a null or one 0 gives 0."""
    x, y = (F.coalesce(v.cast("double"), F.lit(0.0)) if zero_counts else v.cast("double") for v in (a, b))
    d = T.percentage_difference(x, y)
    score = F.when((x == 0) & (y == 0), 1.0).when(d <= tolerance, 1.0 - d / tolerance * 0.2).otherwise(F.greatest(F.lit(0.0), 1.0 - d))
    return F.coalesce(score, F.lit(0.0))


def phone_suffix(a: Column, b: Column) -> Column:
    """Equal digits 1, equal last eight 0.8, equal last seven 0.7, else 0."""
    x, y = N.digits(N.phone_international(a)), N.digits(N.phone_international(b))

    def same(n: int) -> Column:
        return (F.length(x) >= n) & (F.length(y) >= n) & (F.right(x, F.lit(n)) == F.right(y, F.lit(n)))

    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(same(8), 0.8).when(same(7), 0.7).otherwise(0.0)


def attribute_score(weights: Column) -> Column:
    """Logistic function of the summed weights of shared attributes."""
    return 1 / (1 + F.exp(-weights))


def degree_weight(weight: Column, degree: Column) -> Column:
    """An attribute's weight, damped by how many records have it."""
    return weight / (1 + F.log1p(degree))


def map_similarity(a: Column, b: Column, score: Callable[[Column, Column], Column] = containment) -> Column:
    """Mean similarity over the keys that both maps have."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + score(F.element_at(a, k), F.element_at(b, k)).cast("double"))
    return F.when(F.size(keys) > 0, total / F.size(keys)).otherwise(0.0)


def shared_address_segment(a: Column, b: Column) -> Column:
    """Whether both hold one part that ends in a road, lane, number, village or town word."""
    segments = F.lit("([^区县市]+(?:街道|路|弄|号|巷|里|村|镇))")
    return F.arrays_overlap(F.regexp_extract_all(a, segments, 1), F.regexp_extract_all(b, segments, 1))


def text_similar(a: Column, b: Column) -> Column:
    """Character Jaccard of plain texts."""
    return guarded(a, b, char_jaccard(N.plain(a), N.plain(b)))

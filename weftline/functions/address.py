"""Addresses by level: province, city, district, town, street, house number."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from weftline.functions import fuzzy
from weftline.functions.normalize import ADMIN_SUFFIXES, STOPS, address

# --- fixed values: how each level is written, in the order it is looked for --------------------------------
LEVELS = {
    "province": r"[^省市区县]{2,8}(?:省|市|自治区)",
    "city": r"[^省市区县]{2,8}(?:市|州|县)",
    "district": r"[^省市区县镇]{2,8}(?:区|县|开发区|高新区|经济区)",
    "town": r"[^省市区县]{2,8}(?:镇|乡|街道)",
    "street": rf"[^{STOPS}]{{1,20}}(?:路|街|道|巷|里|大街|大道|街道|村|邨|社区|新村|小区|公寓|花园|苑|庄|家园|城|园区)",
    "number": r"\d+(?:弄\d*号?|号|栋|幢|座|楼|室|层)",
    "building": rf"[^{STOPS}]{{2,20}}(?:养老院|敬老院|老年公寓|护理院|福利院|公司|厂|店|馆|所|站|场|生态园|科技园|工业园|产业园|广场|中心|大厦)",
}
WEIGHTS = {"province": 0.10, "city": 0.15, "district": 0.20, "town": 0.20, "street": 0.25, "number": 0.30}
LEAST = {"province": 0.90, "city": 0.90, "district": 0.90, "town": 0.90, "street": 0.90, "number": 0.85}
CRITICAL = ("district", "town", "street", "number")
# ----------------------------------------------------------------------------------------------------------

_PATTERNS = {k: re.compile(v) for k, v in LEVELS.items()}
PARTS = StructType([StructField(k, StringType()) for k in (*LEVELS, "detail")])


def parse(text: str | None, longest: bool = True) -> dict[str, str]:
    """Parts of a normalised address. Each level takes its longest match (or its first) in what earlier levels
    left over; detail is the rest."""
    rest, found = text or "", {}
    for level, pattern in _PATTERNS.items():
        hits = pattern.findall(rest)
        found[level] = (max(hits, key=len) if longest else hits[0]) if hits else ""
        rest = rest.replace(found[level], "", 1) if hits else rest
    return found | {"detail": rest.strip()}


@F.pandas_udf(PARTS)
def _parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        yield pd.DataFrame([parse(x) for x in part], columns=[*LEVELS, "detail"], dtype=object)


def address_parts(value: Column) -> Column:
    """Struct of the parts of an address, normalised first."""
    return _parse(address(value))


def _core(text: str, level: str) -> str:
    for suffix in ADMIN_SUFFIXES.get(level, ()):
        if text.endswith(suffix) and text[: -len(suffix)].strip():
            return text[: -len(suffix)].strip()
    return text


def tolerant(a: str, b: str, level: str) -> float:
    """Slips of writing: equal but for a level's suffix 0.95, equal numbers 0.90, nearly equal 0.9 * ratio; else 0."""
    if level in ADMIN_SUFFIXES and _core(a, level) == _core(b, level):
        return 0.95
    numbers = re.findall(r"\d+", a)
    if level == "number" and numbers and numbers == re.findall(r"\d+", b):
        return 0.90
    near = fuzzy.ratio(a, b)
    return near * 0.9 if near >= 0.85 else 0.0


def part_similarity(a: str, b: str, level: str) -> float:
    if a == b:
        return 1.0
    if slip := tolerant(a, b, level):
        return slip
    if level == "number":
        return 0.0  # house numbers agree or differ
    scores = [fuzzy.ratio(a, b), fuzzy.token_set_ratio(a, b)]
    return max(scores + [fuzzy.partial_ratio(a, b)] if level in ("street", "building") else scores)


def level_similarity(a: dict[str, str], b: dict[str, str]) -> float:
    """Of two parsed addresses. A house number on one side only, or any level that both have and that falls
    below its least similarity, gives 0. Otherwise the weighted mean over the levels that both have, two
    at least, times 1, 0.7 or 0.3 for two and more, one, or no critical level among them."""
    if bool(a["number"]) != bool(b["number"]):
        return 0.0
    scores = {k: part_similarity(a[k], b[k], k) for k in WEIGHTS if a[k] and b[k]}
    if len(scores) < 2 or any(s < LEAST[k] for k, s in scores.items()):
        return 0.0
    mean = sum(s * WEIGHTS[k] for k, s in scores.items()) / sum(WEIGHTS[k] for k in scores)
    return mean * (0.3, 0.7, 1.0)[min(2, sum(k in CRITICAL for k in scores))]


@F.pandas_udf(DoubleType())
def _similar(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        out = []
        for a, b in zip(left, right, strict=True):
            out.append(0.0 if not a or not b else 1.0 if a == b else level_similarity(parse(a), parse(b)))
        yield pd.Series(out, dtype="float64")


def address_similarity(a: Column, b: Column) -> Column:
    """level_similarity of two addresses, normalised first; equal ones 1, an empty one 0."""
    return _similar(address(a), address(b))


# --- dual validation: its own, coarser levels ---------------------------------------------------------------

#: Each level as the shortest text that ends in its word, and its weight.
COARSE = {"province": ("(.*?省)", 0.1), "city": ("(.*?市)", 0.2), "district": ("(.*?[区县])", 0.25), "street": ("(.*?[路街道巷弄])", 0.3), "number": (r"(\d+号?)", 0.35)}


def _lcs_share(a: str, b: str) -> float:
    a, b = a.lower().replace(" ", ""), b.lower().replace(" ", "")
    return 1.0 if a == b else fuzzy.lcs(a, b) / max(len(a), len(b)) if a and b else 0.0


def coarse_similarity(a: str, b: str) -> float:
    """Weighted mean of the longest common subsequence's share over the levels that both have; another house number
    halves it, and so does a result under 0.6."""
    found = [{k: (m[1] if (m := re.search(p, x)) else "") for k, (p, _) in COARSE.items()} for x in (a, b)]
    both = [k for k in COARSE if found[0][k] and found[1][k]]
    if not both:
        return _lcs_share(a, b)
    score = sum(_lcs_share(found[0][k], found[1][k]) * COARSE[k][1] for k in both) / sum(COARSE[k][1] for k in both)
    if "number" in both and found[0]["number"] != found[1]["number"]:
        score *= 0.5
    return min(1.0, score if score >= 0.6 else score * 0.5)


def precise(a: str, b: str, most: int = 50, least: float = 0.7) -> bool:
    """Whether house numbers (at most so far apart) and street names leave room for one place."""
    x, y = (re.search(r"(\d+)号?", t) for t in (a, b))
    if x and y and abs(int(x[1]) - int(y[1])) > most:
        return False
    s, t = (re.search("([^市区县]*?[路街道巷弄])", v) for v in (a, b))
    return not (s and t and _lcs_share(s[1], t[1]) < least)


coarse_udf = fuzzy.pair_udf(coarse_similarity)
precise_udf = fuzzy.pair_udf(lambda a, b: float(precise(a, b)))

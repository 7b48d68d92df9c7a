"""Tokens and keys that records are blocked on, and simple parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions.values import first_present, text

# --- fixed values ---------------------------------------------------------------------------------------
CREDIT_CODE = "^[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}$"
MOBILE_OR_LANDLINE = "^1[3-9][0-9]{9}$|^[0-9]{3,4}-[0-9]{7,8}$"
EMAIL = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$"
ID_CARD = "^[0-9]{17}[0-9Xx]$"
PERSON_NAME = f"^[{N.CJK}]{{2,4}}$"
PLACE_WORDS = "省|市|区|县|街道|路|号|村|镇"
TEXT_STOP_WORDS = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这")
UNIT_STOP_WORDS = ("有限", "公司", "企业", "集团", "工厂", "商店", "中心", "责任", "股份")
ADDRESS_WEIGHTS = {"市": 0.3, "区": 0.4, "县": 0.4, "镇": 0.3, "街道": 0.3, "路": 0.6, "街": 0.6, "道": 0.6, "巷": 0.5, "弄": 0.5, "大道": 0.6}
DATE_FIELDS = ("jcsj", "inspection_date", "create_time", "update_time")
# --------------------------------------------------------------------------------------------------------


def characters(value: Column) -> Column:
    """Distinct characters."""
    return F.array_distinct(F.filter(F.split(F.coalesce(value, F.lit("")), ""), lambda c: c != ""))


def ngrams(value: Column, n: int) -> Column:
    """Distinct runs of n word characters, other characters removed first; none for a text shorter than n."""
    word = F.regexp_replace(F.coalesce(value, F.lit("")), rf"(?U)[^{N.CJK}\w]", "")
    starts = F.sequence(F.lit(1), F.length(word) - (n - 1))
    none = F.array().cast("array<string>")
    fits = (F.length(F.coalesce(value, F.lit(""))) >= n) & (F.length(word) >= n)
    return F.when(fits, F.array_distinct(F.transform(starts, lambda i: word.substr(i, F.lit(n))))).otherwise(none)


def slices(value: Column) -> Column:
    """2-grams and 3-grams together."""
    return F.array_union(ngrams(value, 2), ngrams(value, 3))


def words(value: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of two characters or more, without stop words. Ideographs have no blanks
    between words; a run of them gives its 2-grams."""
    latin = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)
    runs = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(f"([{N.CJK}]{{2,}})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))))
    found = F.array_union(latin, pairs)
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def address_keywords(value: Column) -> Column:
    """First province, city, district and town; up to three streets, two house numbers, two buildings."""
    x = F.coalesce(value, F.lit(""))
    one = [F.regexp_extract(x, f"([{N.CJK}]{{2,}}{end})", 1) for end in ("省", "市", "[区县]", "镇")]
    several = [(r"([^省市区县镇]{2,6}[路街道巷弄])", 3), (r"([0-9]+号?)", 2), (f"([{N.CJK}]{{2,6}}[大厦楼宇院])", 2)]
    lists = [F.slice(F.regexp_extract_all(x, F.lit(p), 1), 1, n) for p, n in several]
    return F.array_distinct(F.filter(F.concat(F.array(*one), *lists), lambda k: k != ""))


def street_terms(value: Column) -> Column:
    """Parts of an address between house, room and floor marks, place suffixes removed, of two characters or more."""
    x = N.without(F.coalesce(value, F.lit("")), "上海市", "市", "区", "县")
    return F.array_distinct(F.filter(F.split(x, r"(?U)[号室层楼\s]+"), lambda k: F.length(k) >= 2))


def weighted_address_keywords(value: Column) -> Column:
    """Places and roads of an address, house numbers cut, with the weight of their kind: map<string, double>."""
    x = F.regexp_replace(F.coalesce(value, F.lit("")), r"\d+号.*$", "")
    x = F.regexp_replace(x, r"[层楼室栋座幢]\d*.*$", "")
    kinds = [("([^省]*?市)", "市", 3), ("([^市]*?区)", "区", 3), ("([^市]*?县)", "县", 3), ("([^区县]*?镇)", "镇", 3), ("([^区县]*?街道)", "街道", 4)]
    kinds += [(f"([^区县镇]*?{end})", end, 2 + len(end)) for end in ("大道", "路", "街", "巷", "弄")]

    def found(pattern: str, end: str, least: int) -> Column:
        long = F.filter(F.regexp_extract_all(x, F.lit(pattern), 1), lambda k: F.length(k) >= least)
        return F.transform(long, lambda k: F.struct(k.alias("key"), F.lit(ADDRESS_WEIGHTS[end]).alias("value")))

    entries = [found(*kind) for kind in kinds]
    every = F.concat(*entries)
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(every, lambda e: e["key"] == k), lambda e: e["value"]))))


def keywords(value: Column, kind: str) -> Column:
    """Index keywords of a value of a kind of field."""
    clean = N.BY_KIND[kind](value)
    none = F.array().cast("array<string>")
    if kind == "unit_name":
        return words(clean, UNIT_STOP_WORDS)
    if kind == "address":
        return address_keywords(clean)
    if kind == "person_name":
        return F.when(F.length(clean) >= 3, F.array(clean, F.left(clean, F.lit(1)))).when(F.length(clean) == 2, F.array(clean)).otherwise(none)
    if kind == "phone":
        return F.when(F.length(clean) >= 7, F.array(clean)).otherwise(none)
    if kind == "id_card":
        region = F.left(clean, F.lit(6))
        return F.when((F.length(clean) == 18) & region.rlike("^[0-9]{6}$"), F.array(clean, region)).when(F.length(clean) == 18, F.array(clean)).otherwise(none)
    if kind == "credit_code":
        return F.when(F.length(clean) == 18, F.array(clean)).otherwise(none)
    if kind == "email":
        parts = F.split(clean, "@")
        return F.when(F.size(parts) == 2, F.concat(F.array(clean), parts)).when(F.size(parts) > 2, F.array(clean)).otherwise(none)
    return words(clean, TEXT_STOP_WORDS)


def match_id(source: Column, target: Column, day: str) -> Column:
    """First 16 hexadecimal digits of the MD5 of both ids and a day (yyyyMMdd), which is a parameter, so that a
    rerun gives the same ids."""
    return F.left(F.md5(F.concat_ws("_", source.cast("string"), target.cast("string"), F.lit(day))), F.lit(16))


def valid_credit_code(value: Column) -> Column:
    return F.upper(text(value)).rlike(CREDIT_CODE)


def valid_phone(value: Column) -> Column:
    """Mobile of 11 digits from 1, landline of 7 or 8, or 10 to 12 with an area code."""
    n = F.length(N.phone(value))
    return n.between(7, 8) | n.between(10, 12)


def percentage_difference(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude; 0 if both are 0, 1 if one is."""
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def ideograph_runs(value: Column) -> Column:
    return F.concat_ws("", F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(f"([{N.CJK}]+)"), 1))


def inspection_date(*fields: Column) -> Column:
    """The first date that is there."""
    return first_present(*fields, missing=("",))


def date_sort_key(*fields: Column) -> Column:
    return F.coalesce(inspection_date(*fields), F.lit(""))

"""Text normalisers for names, addresses, phones and identifier codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.values import text

CJK = r"一-鿿"

# --- fixed values ---------------------------------------------------------------------------------------
FULL_WIDTH = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ（）－"
HALF_WIDTH = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz()-"
DISTRICT_SYNONYMS = {"崇明县": "崇明", "崇明区": "崇明", "浦东新区": "浦东", "浦东县": "浦东", "浦东区": "浦东", "嘉定县": "嘉定", "嘉定区": "嘉定"}
COMPANY_SUFFIXES = ("有限公司", "有限责任公司", "股份有限公司", "股份合作公司", "分公司", "总公司")
NOISE_WORDS = ("办事处", "管理处", "管理部", "项目部", "集团", "中心", "商行", "商社", "商场", "酒店", "宾馆", "股份", "上海市", "上海", "中国")
NOISE_CHARACTERS = "市区县镇乡村"
UNIT_SUFFIXES = ("有限公司", "股份有限公司", "有限责任公司", "公司", "厂", "店", "部", "中心", "所")
BUILDING_TAILS = (
    "养老院|敬老院|老年公寓|护理院|福利院|老人院|颐养院",
    "大厦|大楼|广场|中心|商城|商场|市场|超市",
    "小区|花园|公寓|别墅|村|庄园|家园|苑",
    "写字楼|办公楼|科技园|产业园|工业园",
    "学校|医院|诊所|幼儿园|大学|学院",
    "政府|法院|派出所|消防队|社区|居委会",
    "公司|厂|店|馆|所|站|场|院|园|宾馆|酒店",
)
#: Characters that end the name part of a building.
STOPS = "路街道巷弄里号栋幢座楼室层"
ADMIN_SUFFIXES = {
    "province": ("省", "市", "自治区", "特别行政区"),
    "city": ("市", "地区", "自治州", "盟"),
    "district": ("区", "县", "县级市", "旗"),
    "town": ("街道", "镇", "乡", "办事处"),
    "street": ("路", "街", "道", "大道", "大街", "巷", "弄", "里", "村"),
}
# --------------------------------------------------------------------------------------------------------


def without(value: Column, *parts: str) -> Column:
    """All occurrences of the parts removed, one part after another."""
    return reduce(lambda x, p: F.replace(x, F.lit(p), F.lit("")), parts, value)


def replaced(value: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), value)


def plain(value: Column) -> Column:
    """Blanks collapsed; only word characters, blanks, dots, dashes and brackets stay."""
    return F.regexp_replace(F.regexp_replace(text(value), r"(?U)\s+", " "), rf"(?U)[^{CJK}\w\s.\-()（）]", "")


def digits(value: Column) -> Column:
    return F.regexp_replace(text(value), r"\D", "")


def phone(value: Column) -> Column:
    """Digits without one leading 0 or 86."""
    return F.regexp_replace(digits(value), r"^(0|86)", "")


def phone_without_country(value: Column) -> Column:
    """Digits without a leading 86."""
    return F.regexp_replace(digits(value), r"^86", "")


def phone_international(value: Column) -> Column:
    """Digits and plus signs, without +86, or without 86 where more than 11 characters are there."""
    kept = F.regexp_replace(text(value), r"[^\d+]", "")
    return F.when(kept.startswith("+86"), F.substring(kept, 4, 1000)).when(kept.startswith("86") & (F.length(kept) > 11), F.substring(kept, 3, 1000)).otherwise(kept)


def credit_code(value: Column) -> Column:
    """Upper-case code of 18 characters without blanks, dashes and underscores, else ''."""
    code = F.upper(F.regexp_replace(text(value), r"(?U)[\s\-_]", ""))
    return F.when(F.length(code) == 18, code).otherwise("")


def exact_name(value: Column) -> Column:
    """Brackets of one kind, single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text(value), "（）[]【】", "()()()"), r"(?U)\s+", " ")))


def exact_text(value: Column) -> Column:
    """Lower case without the words for nothing."""
    return without(F.lower(text(value)), "无", "null", "none")


def half_width(value: Column) -> Column:
    return F.translate(value, FULL_WIDTH, HALF_WIDTH)


def stripped_suffixes(value: Column, suffixes: tuple[str, ...]) -> Column:
    """Each suffix in turn taken off where the text then ends with it."""
    return reduce(lambda x, s: F.regexp_replace(x, f"{s}$", ""), suffixes, value)


def fuzzy_name(value: Column) -> Column:
    """District synonyms, half width, lower case; company suffixes, noise words and bracketed parts removed;
    letters, digits and ideographs stay."""
    x = F.lower(half_width(replaced(F.coalesce(value.cast("string"), F.lit("")), DISTRICT_SYNONYMS)))
    x = without(stripped_suffixes(x, COMPANY_SUFFIXES), *NOISE_WORDS)
    word = r"一-龥a-zA-Z0-9"
    for c in NOISE_CHARACTERS:
        x = F.regexp_replace(x, f"(?<![{word}]){c}(?![{word}])", "")
    return F.regexp_replace(F.regexp_replace(x, r"[(（].*?[)）]", ""), f"[^{word}]", "")


def address(value: Column) -> Column:
    """Bare address: fillers removed, city and district completed, house numbers marked, road words unified,
    a building's name at the end cut."""
    x = without(text(value), "市辖区", "县辖区")
    x = F.regexp_replace(x, "^上海(?!市)", "上海市")
    x = F.when(x.contains("虹口区"), x).otherwise(F.replace(x, F.lit("虹口"), F.lit("虹口区")))
    x = F.regexp_replace(x, r"(\d+)#", "$1号")
    x = F.regexp_replace(x, rf"(\d{{1,4}})(?![{'号弄栋幢座楼室层'}\d])", "$1号")
    x = replaced(x, {"大道": "路", "大街": "街"})
    for tails in BUILDING_TAILS:
        x = F.regexp_replace(x, rf"[^{STOPS}]{{1,20}}(?:{tails})$", "")
    return F.regexp_replace(x, r"(?U)\s+", "")


def address_spaceless(value: Column) -> Column:
    return F.regexp_replace(text(value), r"(?U)\s+", "")


def address_characters(value: Column) -> Column:
    """Postcodes, phone-like runs, blanks and marks removed; lower case."""
    x = F.regexp_replace(text(value), r"\d{6}", "")
    x = F.regexp_replace(x, r"[\d\-()\s]{10,}", "")
    return F.lower(F.regexp_replace(x, r"[^一-龥a-zA-Z0-9]", ""))


def address_districts(value: Column) -> Column:
    """County and new-district words as plain district."""
    return replaced(text(value), {"县": "区", "市区": "区", "开发区": "区"})


def spaceless(value: Column) -> Column:
    return F.lower(F.regexp_replace(text(value), r"(?U)\s+", ""))


def words_only(value: Column) -> Column:
    return F.trim(F.regexp_replace(text(value), rf"(?U)[^{CJK}\w\s]", ""))


def unit_name(value: Column) -> Column:
    """One company suffix off the end, then words only."""
    x = text(value)
    cut = reduce(lambda rest, s: F.when(x.endswith(s), x.substr(F.lit(1), F.length(x) - len(s))).otherwise(rest), reversed(UNIT_SUFFIXES), x)
    return words_only(cut)


def ideographs(value: Column) -> Column:
    return F.regexp_replace(text(value), f"[^{CJK}]", "")


def upper_code(value: Column) -> Column:
    return F.upper(text(value))


def email(value: Column) -> Column:
    return F.lower(text(value))


#: Normaliser of each kind of field.
BY_KIND = {
    "text": words_only,
    "unit_name": unit_name,
    "address": address_spaceless,
    "person_name": ideographs,
    "phone": digits,
    "id_card": upper_code,
    "credit_code": upper_code,
    "email": email,
}


def suffix_cut(value: Column, level: str) -> Column:
    """The first suffix of an address level taken off where something is left before it."""
    x = text(value)
    return reduce(lambda rest, s: F.when(x.endswith(s) & (F.length(x) > len(s)), x.substr(F.lit(1), F.length(x) - len(s))).otherwise(rest), reversed(ADMIN_SUFFIXES[level]), x)


def shortened(value: Column, most: int, suffix: str = "...") -> Column:
    x = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(max(0, most - len(suffix)))), F.lit(suffix))).otherwise(x)


def to_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def to_int(value: Column, default: int = 0) -> Column:
    """Whole part of a number written as text."""
    return F.coalesce(value.cast("string").try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def timestamp_text(value: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.coalesce(F.date_format(value, pattern), F.lit(""))


# --- rewriters of unusual addresses, for callers that want them ---------------------------------------------


def highway_address(value: Column) -> Column:
    """Road numbers marked as motorways, a range of kilometres as its end."""
    return address(F.regexp_replace(F.regexp_replace(text(value), r"([SG]\d+)", "高速$1"), r"(\d+)-(\d+)公里", "$1公里"))


def building_address(value: Column) -> Column:
    """Bracketed remarks and room numbers behind lane and house dropped."""
    return address(F.regexp_replace(F.regexp_replace(text(value), "（.*?）", ""), r"(\d+弄\d+号\d+)室", "$1"))


def completed_address(value: Column) -> Column:
    """A city name that was cut short."""
    return address(F.regexp_replace(text(value), "^上(?!海)", "上海市"))

"""Company names by parts: region, core, business, legal form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from weftline.functions import fuzzy

# --- fixed values ---------------------------------------------------------------------------------------
MUNICIPALITIES = ("上海", "北京", "天津", "重庆", "深圳", "广州", "杭州")
LEGAL_FORMS = ("股份有限公司", "有限责任公司", "有限公司", "股份公司", "集团有限公司", "集团公司", "集团", "公司", "企业", "工厂", "厂", "研究院", "研究所", "事务所", "所", "中心", "部")
BUSINESSES = tuple(
    """国际贸易 进出口 工贸 贸易 商贸 外贸 电器 电子 电气 电力 电机 电缆 电线 机械 机电 设备 装备 仪器 仪表 工具
    网络技术 信息技术 科技 技术 信息 软件 网络 通信 数据 化工 化学 医药 生物 制药 药业 化纤 建筑 建设 工程 装饰 装修 设计 规划
    纺织 服装 面料 针织 印染 制衣 时装 食品 餐饮 酒业 饮料 农业 养殖 种植 供应链 物流 运输 仓储 快递 货运 配送
    金融 投资 证券 保险 银行 担保 租赁 房地产 地产 置业 开发 物业 中介 新能源 天然气 能源 石油 煤炭 材料 钢铁 金属 有色 冶金
    零部件 汽车 汽配 摩托 轮胎 维修 塑料 橡胶 玻璃 陶瓷 包装 印刷 出版 广告 传媒 文化 影视 娱乐 人力资源 教育 培训 咨询 服务 管理
    医疗 健康 养老 体育 康复 环保 节能 清洁 回收 处理 净化 购物中心 百货 超市 商厦 商场 购物 零售 批发 实业 控股 发展 创业 创新 智能""".split()
)
CORE_TAILS = tuple("钢结构 工贸 贸易 电器 科技 技术 信息 软件 化工 建筑 装饰 服装 食品 物流 投资 地产 能源 材料 汽车 广告 教育 医疗 环保".split())
SYNONYMS = (
    {"上海市", "上海"}, {"北京市", "北京"}, {"天津市", "天津"}, {"重庆市", "重庆"}, {"深圳市", "深圳"}, {"广州市", "广州"}, {"杭州市", "杭州"}, {"崇明县", "崇明区"},
    {"电器", "电子"}, {"机械", "机电", "设备"}, {"科技", "技术"}, {"化工", "化学"}, {"医药", "药业", "制药"},
    {"有限公司", "公司"}, {"股份有限公司", "股份公司"}, {"集团有限公司", "集团公司", "集团"}, {"浦发", "浦东发展"}, {"同仁堂", "同仁堂药业", "同仁堂医药"},
)
BUSINESS_CONFLICTS = ({"超市", "商厦", "商场", "购物中心", "百货"}, {"化工", "纺织", "食品"}, {"物流", "广告", "咨询", "教育", "医疗"}, {"工贸", "科技"})
PART_WEIGHTS = {"region": 0.05, "core": 0.70, "business": 0.15, "form": 0.10}
CONFLICT_SCORE, CORE_STRICT, VERIFY_BY_ADDRESS, NAME_SHARE, OVERALL_MATCH, ADDRESS_MATCH = 0.3, 0.95, 0.75, 0.6, 0.85, 0.7
REGION_PREFIXES = tuple("北京 上海 广州 深圳 天津 重庆 杭州 南京 武汉 成都 西安 沈阳 大连 青岛 厦门 苏州 无锡 宁波 温州 佛山 东莞 中山 珠海 惠州 江门 湛江 茂名 肇庆 梅州 汕头 中国 全国 国际 亚洲 世界 华东 华南 华北 华中 西南 东北 西北 长三角 珠三角 京津冀".split())
LEGAL_SUFFIXES = tuple("股份有限公司 有限责任公司 集团有限公司 科技有限公司 贸易有限公司 投资有限公司 发展有限公司 实业有限公司 建设有限公司 工程有限公司 咨询有限公司 服务有限公司 有限公司 股份公司 集团公司 集团 公司 厂 店 院 中心 所 部 局 委 会 社 团 协会 基金会".split())
INDUSTRY_WORDS = frozenset(
    """科技 技术 信息 网络 软件 硬件 电子 数码 智能 贸易 商贸 进出口 国际贸易 商务 营销 销售 投资 资本 基金 证券 保险 银行 金融 财务
    建设 建筑 工程 装饰 设计 规划 咨询 制造 生产 加工 机械 设备 工业 实业 服务 管理 顾问 代理 中介 物流 医疗 健康 生物 制药 化工 材料 能源
    教育 培训 文化 传媒 广告 出版 娱乐 房地产 物业 酒店 餐饮 旅游 运输 航空""".split()
)
NAME_SYNONYMS = (
    {"浦东发展银行", "浦发银行", "上海浦发银行"}, {"招商银行", "招行"}, {"中国建设银行", "建设银行", "建行"}, {"中国工商银行", "工商银行", "工行"}, {"中国农业银行", "农业银行", "农行"},
    {"中国银行", "中行"}, {"交通银行", "交行"}, {"腾讯", "腾讯科技", "腾讯计算机系统"}, {"阿里巴巴", "阿里", "阿里巴巴集团"}, {"百度", "百度在线", "百度网络"},
    {"华为", "华为技术", "华为科技"}, {"小米", "小米科技", "小米通讯"}, {"有限公司", "有限", "公司"}, {"股份有限公司", "股份公司", "股份"}, {"集团有限公司", "集团公司", "集团"}, {"科技有限公司", "科技公司", "科技"},
)
BLEND = {"exact": 0.40, "core": 0.35, "industry": 0.15, "characters": 0.10}
# --------------------------------------------------------------------------------------------------------

_REGION = re.compile(rf"(?:{'|'.join(MUNICIPALITIES)})市?(?:[一-龥]{{2,4}}?(?:新区|区|县))?|[一-龥]{{2,8}}(?:市|区|县|省)")
_LONGEST_BUSINESS = sorted(BUSINESSES, key=len, reverse=True)
NAME_PARTS = StructType([*[StructField(k, StringType()) for k in ("region", "core", "business", "form")], StructField("confidence", DoubleType())])
_EMPTY = {"region": "", "core": "", "business": "", "form": "", "confidence": 0.0}


def parse(name: str | None) -> dict:
    """Parts of a company name: region in front, legal form at the end, the longest business word in between, and
    the core that is left, without a business word at its end. Bracketed remarks don't count."""
    if not name or not name.strip():
        return dict(_EMPTY)
    whole = name.strip()
    rest = re.sub(r"[（(][^）)]*[）)]", "", whole)
    region = m[0] if (m := _REGION.match(rest)) else ""
    rest = rest[len(region) :]
    form = next((f for f in LEGAL_FORMS if rest.endswith(f)), "")
    rest = rest[: len(rest) - len(form)]
    business = next((b for b in _LONGEST_BUSINESS if b in rest), "")
    core = rest.replace(business, "", 1).strip() if business else rest.strip()
    if tail := next((t for t in CORE_TAILS if core.endswith(t) and len(core) > len(t)), ""):
        core, business = core[: -len(tail)].strip(), business or tail
    parts = {"region": region, "core": core, "business": business, "form": form}
    covered = sum(map(len, parts.values())) / len(whole)
    return parts | {"confidence": min(1.0, 0.5 * covered + 0.3 * bool(core) + 0.1 * bool(business) + 0.1 * bool(form))}


def conflicting(a: str, b: str) -> bool:
    return any(a in group and b in group and (a != b or len(group) > 2) for group in BUSINESS_CONFLICTS) if a and b else False


def core_similarity(a: str, b: str) -> float:
    """Strict: one within the other 1; different lengths ratio - 0.2 for each character; short cores 0.5 for one
    different character, 0.3 for more; longer ones 1 - 1.5 * share of different characters."""
    if not a or not b:
        return 0.0
    if a == b or (min(len(a), len(b)) >= 2 and (a in b or b in a)) or any(a in g and b in g for g in SYNONYMS):
        return 1.0
    if len(a) != len(b):
        return max(0.0, fuzzy.ratio(a, b) - 0.2 * abs(len(a) - len(b)))
    different = sum(x != y for x, y in zip(a, b, strict=True))
    if len(a) <= 4:
        return 0.5 if different == 1 else 0.3
    return max(0.0, 1.0 - 1.5 * different / len(a))


def part_similarity(a: str, b: str, part: str) -> float:
    if part == "core":
        return core_similarity(a, b)
    if not a or not b:
        return 0.5
    if a == b or any(a in g and b in g for g in SYNONYMS):
        return 1.0
    return fuzzy.partial_ratio(a, b) if part == "region" else fuzzy.ratio(a, b)


def structured(a: str | None, b: str | None, address_a: str = "", address_b: str = "") -> dict:
    """Similarity of two names by their parts. A business conflict sets that part to 0.3. Names that are close but
    whose cores differ are weighed 0.6 to 0.4 with their addresses, if both are given. Matched: a strict core and
    overall similarity, or verified addresses; never with a conflict."""
    x, y = parse(a), parse(b)
    scores = {k: part_similarity(x[k], y[k], k) for k in PART_WEIGHTS}
    conflict = conflicting(x["business"], y["business"])
    if conflict:
        scores["business"] = CONFLICT_SCORE
    overall = sum(scores[k] * w for k, w in PART_WEIGHTS.items())
    strict = scores["core"] >= CORE_STRICT
    near, verify = 0.0, overall >= VERIFY_BY_ADDRESS and not strict and bool(address_a) and bool(address_b)
    if verify:
        near = fuzzy.best_ratio(address_a, address_b)
        overall = NAME_SHARE * overall + (1 - NAME_SHARE) * near
    matched = not conflict and ((strict and overall >= OVERALL_MATCH) or (verify and near >= ADDRESS_MATCH))
    return {"overall": overall, "core": scores["core"], "region": scores["region"], "business": scores["business"], "form": scores["form"], "address": near, "conflict": conflict, "matched": matched, "source_core": x["core"], "target_core": y["core"]}


STRUCTURED = StructType([*[StructField(k, DoubleType()) for k in ("overall", "core", "region", "business", "form", "address")], StructField("conflict", BooleanType()), StructField("matched", BooleanType()), StructField("source_core", StringType()), StructField("target_core", StringType())])


@F.pandas_udf(NAME_PARTS)
def _parse(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in names:
        yield pd.DataFrame([parse(x) for x in part], columns=list(_EMPTY))


@F.pandas_udf(STRUCTURED)
def _structured(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        yield pd.DataFrame([structured(a, b, c or "", d or "") for a, b, c, d in zip(*rows, strict=True)], columns=STRUCTURED.names)


def name_parts(value: Column) -> Column:
    return _parse(value.cast("string"))


def structured_similarity(a: Column, b: Column, address_a: Column | None = None, address_b: Column | None = None) -> Column:
    """Struct of structured(); addresses are reduced to their characters first."""
    from weftline.functions.normalize import address_characters

    none = F.lit("")
    return _structured(a.cast("string"), b.cast("string"), none if address_a is None else address_characters(address_a), none if address_b is None else address_characters(address_b))


def segmented(name: str) -> tuple[str, list[str], list[str], str]:
    """(region, core words, industry words, legal suffix): industry words are cut out by longest match, what lies
    between them are core words."""
    rest = name.strip()
    region = max((p for p in REGION_PREFIXES if rest.startswith(p)), key=len, default="")
    rest = rest[len(region) :].strip()
    suffix = next((s for s in LEGAL_SUFFIXES if rest.endswith(s)), "")
    rest = rest[: len(rest) - len(suffix)].strip()
    pattern = "|".join(sorted(INDUSTRY_WORDS, key=len, reverse=True))
    industry = re.findall(pattern, rest)
    core = [w for w in re.split(rf"{pattern}|\s+", rest) if w]
    return region, core, industry, suffix


def _standard(word: str) -> str:
    return next((min(g, key=len) for g in NAME_SYNONYMS if word in g), word)


def intelligent(a: str | None, b: str | None) -> float:
    """Blend of exactness, core words, industry words and characters, plus a bonus for synonyms, less a penalty for
    cores that have nothing in common (0.8 if any two of their words look alike, else 0.3)."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    (ra, ca, ia, sa), (rb, cb, ib, sb) = segmented(a), segmented(b)
    exact = 1.0 if (ra, ca, ia, sa) == (rb, cb, ib, sb) else 0.9 if ca and set(ca) == set(cb) else 0.0
    x, y = ({_standard(w) for w in c} for c in (ca, cb))
    core = len(x & y) / len(x | y) if x and y else 0.0
    industry = len(set(ia) & set(ib)) / len(set(ia) | set(ib)) if ia and ib else 0.3 if ia or ib else 0.0
    bonus = 0.5 if any(set(ca + ia) & g and set(cb + ib) & g for g in NAME_SYNONYMS) else 0.0
    penalty = 0.0
    if x and y and not x & y:
        alike = any(len(p) >= 2 and len(q) >= 2 and 0.5 <= fuzzy.ratio(p, q) < 1 for p, q in product(x, y))
        penalty = 0.8 if alike else 0.3
    blend = exact * BLEND["exact"] + core * BLEND["core"] + industry * BLEND["industry"] + fuzzy.ratio(a, b) * BLEND["characters"]
    return max(0.0, min(1.0, (blend + 0.2 * bonus) * (1 - penalty)))


intelligent_udf = fuzzy.pair_udf(intelligent)

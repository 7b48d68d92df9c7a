"""Names that look alike and are not: conflicts of words, brands, patterns, and near-equal words."""

from __future__ import annotations

import re

from pyspark.sql import Column

from weftline.functions import fuzzy
from weftline.functions.names import segmented

# --- fixed values ---------------------------------------------------------------------------------------
WORD_PAIRS = (
    ("为民", "惠民"), ("为民", "利民"), ("惠民", "利民"), ("民生", "民康"), ("民康", "民安"), ("华为", "华美"), ("华为", "华兴"), ("华为", "华泰"), ("华美", "华兴"), ("腾讯", "腾达"), ("腾讯", "腾飞"), ("阿里", "阿拉"),
    ("百度", "百达"), ("招商", "招行"), ("工商", "农商"), ("建设", "建行"), ("精工", "精密"), ("精工", "精华"), ("机械", "机电"), ("物流", "物业"), ("贸易", "商贸"), ("咨询", "资讯"),
)
BRANDS = tuple(
    """华为 腾讯 阿里巴巴 百度 字节跳动 小米 OPPO VIVO 联想 海尔 美的 格力 比亚迪 大疆 工商银行 建设银行 农业银行 中国银行 交通银行
    招商银行 浦发银行 民生银行 兴业银行 中国移动 中国联通 中国电信 京东 拼多多 美团 滴滴 网易 搜狐 新浪""".split()
)
INNER_PAIRS = (("为民", "惠民"), ("华为", "华美"), ("精工", "精密"), ("物流", "物业"), ("胜利", "盛利"), ("宏达", "弘达"), ("创新", "创兴"))
SCORES = {"words": 0.95, "brands": 0.98, "inner": 0.90, "near": 0.85}
CORE_SUFFIXES = ("有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "科技有限公司", "贸易有限公司", "实业有限公司", "发展有限公司", "分公司", "经营部", "工作室", "合作社", "个体工商户")
DISTRICTS = tuple("浦东新区 黄浦区 徐汇区 长宁区 静安区 普陀区 虹口区 杨浦区 闵行区 宝山区 嘉定区 金山区 松江区 青浦区 奉贤区 崇明区".split())
BLEND = {"exact": 0.25, "core_exact": 0.20, "token_set": 0.20, "core_sorted": 0.15, "blocks": 0.10, "jaccard": 0.05, "overlap": 0.05}
# --------------------------------------------------------------------------------------------------------


def _across(a: str, b: str, pair: tuple[str, str]) -> bool:
    x, y = pair
    return (x in a and y in b) or (y in a and x in b)


def conflict(a: str, b: str) -> float:
    """How sure it is that two like names are different ones; 0 if nothing says so."""
    if any(_across(a, b, p) for p in WORD_PAIRS):
        return SCORES["words"]
    left, right = ({x for x in BRANDS if x in n} for n in (a, b))
    if left and right and left != right:
        return SCORES["brands"]
    if any(_across(a[1:-1], b[1:-1], p) for p in INNER_PAIRS):
        return SCORES["inner"]
    for x in segmented(a)[1]:
        for y in segmented(b)[1]:
            if min(len(x), len(y)) >= 2 and 0.7 <= fuzzy.ratio(x, y) < 0.95 and len(x) == len(y) and 1 <= sum(c != d for c, d in zip(x, y, strict=True)) <= 2:
                return SCORES["near"]
    return 0.0


def company_name(name: str) -> str:
    """One kind of bracket, no marks, remarks on the legal form dropped, the city in its short form."""
    out = re.sub(r"[^\w一-鿿()]", "", name.strip().replace("（", "(").replace("）", ")"))
    for old, new in (("(有限)", ""), ("(个体工商户)", ""), ("上海市", "上海")):
        out = out.replace(old, new)
    return out


def core_name(name: str) -> str:
    """Without the longest company suffix, the city and the district."""
    out = company_name(name)
    suffix = max((s for s in CORE_SUFFIXES if out.endswith(s)), key=len, default="")
    out = out[: len(out) - len(suffix)].removeprefix("上海")
    return out.removeprefix(next((d for d in DISTRICTS if out.startswith(d)), "")).strip()


def blended(a: str, b: str) -> float:
    """Weighted sum of seven similarities of two names and of their cores."""
    x, y, cx, cy = company_name(a), company_name(b), core_name(a), core_name(b)
    wx, wy = ({*segmented(c)[1], *segmented(c)[2]} for c in (cx, cy))
    both = len(wx & wy)
    parts = {
        "exact": float(x == y), "core_exact": float(cx == cy), "token_set": fuzzy.token_set_ratio(x, y), "core_sorted": fuzzy.token_sort_ratio(cx, cy), "blocks": fuzzy.matching_blocks_ratio(x, y),
        "jaccard": both / len(wx | wy) if wx and wy else 0.0, "overlap": both / min(len(wx), len(wy)) if wx and wy else 0.0,
    }
    return min(1.0, sum(parts[k] * w for k, w in BLEND.items()))


conflict_udf = fuzzy.pair_udf(conflict)
blended_udf = fuzzy.pair_udf(blended)


def record_blend(name_a: Column, name_b: Column, address_a: Column, address_b: Column) -> Column:
    """0.8 of the names' blend and 0.2 of the addresses' ratio."""
    from weftline.functions.normalize import address

    return 0.8 * blended_udf(name_a, name_b) + 0.2 * fuzzy.ratio_udf(address(address_a), address(address_b))

"""Column functions on literal rows."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import address, fuzzy, names
from weftline.functions import normalize as N
from weftline.functions import similarity as S
from weftline.functions import tokens as T
from weftline.functions import values as V


def apply(spark, f, rows):
    """f over the columns a, b, ... of literal rows."""
    width = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in "abcdef"[:width]))
    return [r[0] for r in df.select(f(*[F.col(c) for c in "abcdef"[:width]]).alias("x"), "i").orderBy("i").collect()]


CODE = "91310101MA1FPX1234"


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (N.credit_code, [(CODE.lower(), CODE), ("9131 0101-MA1FPX_1234", CODE), (CODE[:-1], ""), (None, ""), ("", "")]),
        (N.phone, [("+86 138-0000-1111", "13800001111"), ("02155556666", "2155556666"), ("86021", "021"), (None, "")]),
        (N.phone_without_country, [("8613800001111", "13800001111"), ("021", "021")]),
        (N.phone_international, [("+8613800001111", "13800001111"), ("8613800001111", "13800001111"), ("86123", "86123"), ("(021)1", "0211")]),
        (N.exact_name, [(" A（b）  C【d】", "a(b) c(d)"), (None, "")]),
        (N.exact_text, [("无NULLxNone", "x"), (None, "")]),
        (N.plain, [("  a  b，c-d(e)", "a bc-d(e)"), (None, "")]),
        (N.fuzzy_name, [("上海Ａ１电子（徐汇）有限公司", "a1电子"), ("浦东新区X分公司", "浦东x"), ("A市B", "a市b"), (None, "")]),
        (N.address, [("上海虹口天宝路881", "上海市虹口区天宝路881号"), ("上海市市辖区虹口区天宝大道8#", "上海市虹口区天宝路8号"), ("天宝路8号爱心养老院", "天宝路8号"), (None, "")]),
        (N.unit_name, [("宏达有限公司", "宏达"), ("宏达股份有限公司", "宏达股份"), ("宏达", "宏达")]),
        (N.ideographs, [("a王b小明", "王小明")]),
        (N.address_characters, [("200080 天宝路-1 A", "天宝路1a")]),
        (T.valid_credit_code, [(CODE, True), ("x", False)]),
        (T.valid_phone, [("13800001111", True), ("5555666", True), ("123", False), (None, False)]),
        (T.ideograph_runs, [("a王b小明", "王小明"), (None, "")]),
        (lambda x: F.concat_ws(",", T.ngrams(x, 2)), [("abab", "ab,ba"), ("a", ""), ("a b", "ab"), (None, "")]),
        (lambda x: F.concat_ws(",", T.words(x)), [("The the a cat", "the,cat"), ("天宝路", "天宝,宝路")]),
        (lambda x: F.concat_ws(",", T.keywords(x, "person_name")), [("王小明", "王小明,王"), ("王明", "王明"), ("王", "")]),
        (lambda x: F.concat_ws(",", T.keywords(x, "email")), [("A@B.c", "a@b.c,a,b.c"), ("x", "")]),
        (lambda x: F.concat_ws(",", T.keywords(x, "id_card")), [("310101199001011234", "310101199001011234,310101")]),
        (lambda x: F.concat_ws(",", T.address_keywords(x)), [("上海市虹口区天宝路881号", "上海市,上海市虹口区,天宝路,881号")]),
        (lambda x: V.first_present(x, F.lit("z")), [("-", "z"), ("null", "z"), ("a", "a"), (None, "z")]),
        (lambda x: N.suffix_cut(x, "district"), [("虹口区", "虹口"), ("区", "区")]),
        (lambda x: N.shortened(x, 5), [("abcdefgh", "ab..."), ("abc", "abc")]),
        (lambda x: N.to_int(x), [("12.7", 12), ("x", 0)]),
    ],
)
def test_of_one_value(spark, f, cases):
    assert apply(spark, f, [(a,) for a, _ in cases]) == [b for _, b in cases]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (S.levenshtein, [("kitten", "sitting", 4 / 7), ("a", "a", 1.0), ("ab", "abc", 0.8), ("", "a", 0.0), (None, "a", 0.0)]),
        (S.char_jaccard, [("kitten", "sitting", 3 / 7), ("", "", 0.0)]),
        (S.lcs_share, [("kitten", "sitting", 4 / 7), ("abc", "abc", 1.0), ("", "a", 0.0)]),
        (S.exact_or_contained, [("A", "a", 1.0), ("ab", "xABx", 0.7), ("a", "b", 0.0)]),
        (S.phone_suffix, [("13812345678", "13812345678", 1.0), ("13812345678", "99912345678", 0.8), ("2345678", "99992345678", 0.7), ("1", "2", 0.0), ("", "1", 0.0)]),
        (lambda a, b: S.numeric(a.cast("double"), b.cast("double")), [("10", "10", 1.0), ("0", "0", 1.0), ("0", "5", 0.0), ("95", "100", 0.9), ("50", "100", 0.5), ("-95", "-100", 0.9)]),
        (S.place_jaccard, [("天宝路", "天宝路", 1.0), ("天宝路", "四平路", 0.2 * 1.2)]),
        (S.weighted_keyword_jaccard, [("上海市虹口区", "上海市虹口区", 1.0), ("", "上海市", 0.0)]),
        (fuzzy.phone_similarity, [("13812345678", "13812345678", 1.0), ("13812345678", "99992345678", 0.8)]),
        (address.address_similarity, [("上海虹口天宝路881", "上海市虹口区天宝路881号", 1.0), ("上海市虹口区天宝路881号", "上海市虹口区天宝路882号", 0.0), ("上海市虹口区天宝路", "上海市虹口区天宝路8号", 0.0), ("上海市虹口区天宝路8号", "上海市杨浦区天宝路8号", 0.0), ("", "x", 0.0)]),
        (lambda a, b: names.structured_similarity(a, b)["core"], [("上海宏达电子有限公司", "上海宏大电子有限公司", 0.5), ("上海宏达电子有限公司", "上海宏达机械有限公司", 1.0), ("", "x", 0.0)]),
        (lambda a, b: names.structured_similarity(a, b)["conflict"].cast("int"), [("上海宏达百货有限公司", "上海宏达商厦有限公司", 1), ("宏达电子有限公司", "宏达贸易有限公司", 0)]),
        (names.intelligent_udf, [("上海宏达电子有限公司", "上海宏达电子有限公司", 1.0), ("", "x", 0.0)]),
    ],
)
def test_of_two_values(spark, f, cases):
    found = apply(spark, f, [c[:2] for c in cases])
    assert found == pytest.approx([c[2] for c in cases], abs=1e-9)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = (before + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


words = st.text(alphabet="abc 天宝", max_size=9)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_ratios(a, b):
    assert fuzzy.lcs(a, b) == plain_lcs(a, b)
    for f in (fuzzy.ratio, fuzzy.partial_ratio, fuzzy.token_sort_ratio, fuzzy.token_set_ratio, fuzzy.weighted_ratio, fuzzy.tfidf_cosine, fuzzy.slice_blend, fuzzy.name_blend):
        x = f(a, b)
        assert -1e-9 <= x <= 1 + 1e-9
        assert x == pytest.approx(f(b, a))
    if a.split():
        assert fuzzy.ratio(a, a) == fuzzy.token_set_ratio(a, a) == fuzzy.token_sort_ratio(a, a) == 1


def test_address_parts():
    p = address.parse("上海市虹口区天宝路881号爱心大厦")
    assert (p["province"], p["district"], p["street"], p["number"], p["building"]) == ("上海市", "虹口区", "天宝路", "881号", "爱心大厦")
    one = {k: "" for k in (*address.LEVELS, "detail")}
    assert address.level_similarity(one | {"province": "上海市"}, one | {"province": "上海市"}) == 0
    two = one | {"province": "上海市", "city": "a市"}
    assert address.level_similarity(two, two) == pytest.approx(0.3)


def test_name_parts():
    p = names.parse("上海市虹口区宏达电子（集团）股份有限公司")
    assert (p["region"], p["core"], p["business"], p["form"]) == ("上海市虹口区", "宏达", "电子", "股份有限公司")
    assert names.parse(None)["core"] == "" and names.parse("  ")["confidence"] == 0
    assert names.core_similarity("宏达", "宏达电子") == 1 and names.core_similarity("宏达", "") == 0


def test_conflicts_and_blends():
    from weftline.functions import conflicts as C

    assert C.conflict("上海为民食品", "上海惠民食品") == 0.95 and C.conflict("小米之家", "联想之家") == 0.98 and C.conflict("a宏达b", "a弘达b") == 0.90
    assert C.conflict("永兴隆", "永兴盛") == 0.0 and C.conflict("天天永兴隆", "天天永兴盛") == 0.85 and C.conflict("x", "x") == 0.0
    assert C.core_name("上海市虹口区宏达（有限）科技有限公司") == "宏达"
    assert C.blended("上海宏达有限公司", "上海市宏达有限公司") == pytest.approx(1.0) and 0 <= C.blended("a", "b") <= 1
    assert address.coarse_similarity("上海市虹口区天宝路8号", "上海市虹口区天宝路8号") == 1
    assert address.coarse_similarity("上海市虹口区天宝路8号", "上海市虹口区天宝路9号") < 0.5
    assert address.precise("天宝路8号", "天宝路40号") and not address.precise("天宝路8号", "天宝路80号") and not address.precise("天宝路8号", "四平街8号")


def test_unusual_addresses(spark):
    assert apply(spark, N.completed_address, [("上天宝路8号",), ("上海天宝路8",)]) == ["上海市天宝路8号", "上海市天宝路8号"]
    assert apply(spark, N.building_address, [("天宝路8弄2号301室（北门）",)]) == ["天宝路8弄2号301号"]


def test_weights_are_renormalised(spark):
    parts = lambda a, b: V.weighted_mean([(F.lit(1.0), a.isNotNull(), 0.4), (F.lit(0.5), b.isNotNull(), 0.6)])
    assert apply(spark, parts, [("x", "y"), ("x", None), (None, "y"), (None, None)]) == pytest.approx([0.7, 1.0, 0.5, 0.0])


def test_enhanced_adjustments(spark):
    from weftline.operators.scoring import enhanced_score

    def score(base=0.8, core=0.85, conflict=False, name=0.5, place=0.5, a="宏达宏", b="宏达宏"):
        df = spark.range(1).select(enhanced_score(F.lit(base), F.lit(core), F.lit(conflict), F.lit(name), F.lit(place), F.lit(a), F.lit(b)).alias("x"))
        return df.first()[0]

    assert score() == pytest.approx(0.8)
    assert score(core=0.95) == pytest.approx(1.0)
    assert score(conflict=True) == pytest.approx(0.5)
    assert score(name=0.9, place=0.1) == pytest.approx(0.6)
    assert score(core=0.6) == pytest.approx(0.5)
    assert score(core=0.9, base=0.5, conflict=True) == pytest.approx(0.45)
    assert score(a="宏达", b="宏大") == pytest.approx(0.3)
    assert score(core=0.95, name=0.9, place=0.1) == pytest.approx(0.6)


def test_blocking_finds_all_pairs(spark):
    from weftline.operators.blocking import self_pairs, token_join

    rows = [(i, sorted({c for c in w})) for i, w in enumerate("".join(p) for p in itertools.product("abcd", repeat=3))]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    for least in (0.3, 0.5, 0.67, 1.0):
        found = {(r.src, r.tgt) for r in token_join(df.withColumnRenamed("id", "src"), df.withColumnRenamed("id", "tgt"), least).collect()}
        assert found == {(i, j) for i, a in rows for j, b in rows if len(set(a) & set(b)) / len(a) >= least - 1e-9}
        pairs = {(r.a, r.b) for r in self_pairs(df, least).collect()}
        assert pairs == {(i, j) for i, a in rows for j, b in rows if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= least - 1e-9}

"""Profiles, schema inference and validation of tables.

A profile is one wide aggregation over the table, turned to one row per column; distinct values are counted exactly.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import tokens as K
from weftline.functions.normalize import CJK
from weftline.functions.values import ratio

# --- fixed values ---------------------------------------------------------------------------------------
NAME_HINTS = {
    "name": ("名称", "姓名", "name", "公司", "企业", "单位", "机构"),
    "address": ("地址", "位置", "address", "所在地", "注册地"),
    "phone": ("电话", "手机", "phone", "tel", "联系方式", "联系电话"),
    "email": ("邮箱", "邮件", "email", "mail"),
    "date": ("时间", "日期", "date", "time", "创建时间", "更新时间"),
    "id": ("id", "编号", "代码", "标识"),
    "money": ("金额", "价格", "费用", "成本", "收入", "支出", "money", "price"),
    "person": ("法人", "代表", "负责人", "联系人", "经理", "主管"),
}
FIELD_HINTS = (
    ("address", ("address", "地址", "addr", "位置")), ("unit_name", ("name", "名称", "单位", "unit", "company")), ("person_name", ("person", "人名", "姓名", "法人", "联系人")),
    ("phone", ("phone", "电话", "tel", "手机")), ("id_card", ("id", "身份证", "card")), ("credit_code", ("credit", "信用代码", "code")), ("email", ("email", "邮箱", "mail")),
)
VALUE_PATTERNS = (("phone", K.MOBILE_OR_LANDLINE, 0.7), ("email", K.EMAIL, 0.7), ("id_card", K.ID_CARD, 0.7), ("credit_code", K.CREDIT_CODE, 0.7), ("address", K.PLACE_WORDS, 0.5), ("person_name", K.PERSON_NAME, 0.6))
PHONE, ID_NUMBER = r"^(\+86)?1[3-9][0-9]{9}$|^[0-9]{3,4}-[0-9]{7,8}$", "^[0-9]{15}$|^[0-9]{17}[0-9X]$"
ORGANISATION_WORDS = "公司|企业|集团|有限|股份|合作社|事务所|中心|机构"
COMPANY_TAILS = "有限公司|股份公司|集团公司|公司|集团|厂|店|院|所|中心"
PLACE_HINTS = "省|市|区|县|街道|路|号|楼|层"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n")
# --------------------------------------------------------------------------------------------------------

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)


def unpivoted(wide: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row of `column__field` values -> one row per column with the fields."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns])
    return wide.select(F.explode(entries).alias("x")).select("x.*")


def counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, nulls, distinct values and their shares, of each column, in one pass."""
    columns = columns or df.columns
    every = [x for c in columns for x in (F.count("*").alias(f"{c}__rows"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.count_distinct(F.col(c)).alias(f"{c}__distinct_values"))]
    out = unpivoted(df.agg(*every), columns, ["rows", "nulls", "distinct_values"])
    return out.withColumn("null_share", ratio(F.col("nulls"), F.col("rows"))).withColumn("unique_share", ratio(F.col("distinct_values"), F.col("rows")))


def quartiles(x: Column, accuracy: int | None = None) -> Column:
    """Array of the quartiles: interpolated exact ones, for which a task keeps a count of each distinct value; with an
    accuracy approximate ones in bounded memory."""
    thirds = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return F.percentile(x, thirds) if accuracy is None else F.percentile_approx(x, thirds, accuracy)


def numeric_summary(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """min, max, mean, sample deviation, quartiles, zeros and negatives of each numeric column."""
    columns = columns or [c for c in df.columns if is_numeric(df, c)]
    every = []
    for c in columns:
        x = F.col(c).cast("double")
        parts = {"min_value": F.min(x), "max_value": F.max(x), "mean": F.avg(x), "std": F.stddev_samp(x), "quartiles": quartiles(x, accuracy), "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0)}
        every += [v.alias(f"{c}__{k}") for k, v in parts.items()]
    out = unpivoted(df.agg(*every), columns, list(parts))
    for i, name in enumerate(("q1", "median", "q3")):
        out = out.withColumn(name, F.col("quartiles")[i])
    return out.drop("quartiles")


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lengths, empty values, and values with ideographs, Latin letters, digits, of each text column."""
    every = []
    for c in columns:
        x = F.col(c).cast("string")
        parts = {"min_length": F.min(F.length(x)).cast("long"), "max_length": F.max(F.length(x)).cast("long"), "avg_length": F.avg(F.length(x)), "empty": F.count_if(x == ""), "cjk": F.count_if(x.rlike(f"[{CJK}]")), "latin": F.count_if(x.rlike("[a-zA-Z]")), "digits": F.count_if(x.rlike("[0-9]"))}
        every += [v.alias(f"{c}__{k}") for k, v in parts.items()]
    return unpivoted(df.agg(*every), columns, list(parts))


def basics(df: DataFrame) -> DataFrame:
    """Rows, columns, rows beyond the first of equal ones, and rows of nulls only."""
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    each = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return each.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(empty, F.col("__n"))), F.lit(0)).alias("empty_rows"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value (ties by value) and its frequency, of each column."""
    parts = []
    for c in columns:
        n = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("frequency"))
        parts.append(n.orderBy(F.desc("frequency"), "value").limit(1).select(F.lit(c).alias("column"), "value", "frequency"))
    return reduce(DataFrame.unionByName, parts)


def outliers(df: DataFrame, columns: list[str], factor: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """Values beyond `factor` interquartile ranges from the quartiles, of each column."""
    found = df.agg(*[quartiles(F.col(c).cast("double"), accuracy).alias(c) for c in columns])
    bounds = found.select(*[F.col(c)[i].alias(f"{c}__{k}") for c in columns for k, i in (("q1", 0), ("q3", 2))])
    joined = df.select(*columns).crossJoin(F.broadcast(bounds))  # one row of bounds
    every = []
    for c in columns:
        x, q1, q3 = F.col(c).cast("double"), F.col(f"{c}__q1"), F.col(f"{c}__q3")
        every += [F.count_if((x < q1 - factor * (q3 - q1)) | (x > q3 + factor * (q3 - q1))).alias(f"{c}__outliers"), F.count("*").alias(f"{c}__rows")]
    return unpivoted(joined.agg(*every), columns, ["outliers", "rows"])


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Pearson correlation of each pair of columns, those of magnitude over `least`."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}__r") for a, b in pairs])
    out = unpivoted(wide, [f"{a}|{b}" for a, b in pairs], ["r"])
    names = F.split("column", r"\|")
    return out.select(names[0].alias("column_a"), names[1].alias("column_b"), "r").filter(F.abs("r") > least)


def dependencies(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Strength of each functional dependency a -> b: share of a's values with one value of b only."""
    parts = []
    for a, b in permutations(columns, 2):
        groups = df.filter(F.col(a).isNotNull()).groupBy(a).agg(F.count_distinct(b).alias("n"))
        parts.append(groups.agg(F.avg((F.col("n") == 1).cast("double")).alias("strength")).select(F.lit(a).alias("determinant"), F.lit(b).alias("dependent"), "strength"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("strength") > least)


def issues(profile: DataFrame) -> DataFrame:
    """Issues of counts(): too many nulls, nearly all unique, hardly diverse."""
    p, u = F.col("null_share"), F.col("unique_share")
    found = F.array_compact(F.array(F.when(p > 0.5, "many_nulls"), F.when(u > 0.95, "nearly_unique"), F.when(u < 0.05, "low_diversity")))
    return profile.withColumn("issues", found)


def numeric_as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns whose values all are numbers."""
    wide = df.agg(*[(F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) == 0).alias(f"{c}__numeric") for c in columns])
    return unpivoted(wide, columns, ["numeric"])


def encoding_hints(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).contains("?") | F.col(c).contains("乱码")).alias(f"{c}__suspect") for c in columns])
    return unpivoted(wide, columns, ["suspect"]).filter("suspect > 0")


def key_candidates(profile: DataFrame) -> DataFrame:
    """Primary: unique without nulls (high), or nearly so (medium); foreign by name."""
    u, n, name = F.col("unique_share"), F.col("nulls"), F.lower("column")
    primary = F.when((u == 1) & (n == 0), "high").when((u > 0.95) & (n < F.col("rows") * 0.1), "medium")
    foreign = name.endswith("id") | name.contains("编号") | name.contains("代码")
    return profile.select("column", primary.alias("primary_key"), foreign.alias("foreign_key"), (u > 0.9).alias("identifier"))


def type_recommendations(profile: DataFrame, types: DataFrame) -> DataFrame:
    """Columns stored as text that hold dates or numbers, and texts of few values."""
    joined = profile.join(types, "column")
    advice = F.when((F.col("stored") == "string") & (F.col("inferred") == "date"), "timestamp").when((F.col("stored") == "string") & (F.col("inferred") == "number"), "number").when((F.col("stored") == "string") & (F.col("unique_share") < 0.5), "dictionary")
    return joined.select("column", advice.alias("advice")).filter("advice is not null")


def _share(x: Column, hit: Column) -> Column:
    return ratio(F.count_if(x.isNotNull() & (x != "") & hit), F.count_if(x.isNotNull() & (x != "")))


def value_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """number, date, boolean or string by over 0.8 of a column's values, all of them; unknown without values."""
    columns = columns or df.columns
    every = []
    for c in columns:
        x = F.trim(F.col(c).cast("string"))
        number = x.try_cast("double").isNotNull()
        date = ~number & x.try_cast("timestamp").isNotNull()
        every += [_share(x, number).alias(f"{c}__number"), _share(x, date).alias(f"{c}__date"), _share(x, ~number & F.lower(x).isin(*BOOLEAN_WORDS)).alias(f"{c}__boolean"), F.count_if(x != "").alias(f"{c}__n")]
    out = unpivoted(df.agg(*every), columns, ["number", "date", "boolean", "n"])
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("number") > 0.8, "number").when(F.col("date") > 0.8, "date").when(F.col("boolean") > 0.8, "boolean").otherwise("string")
    return out.withColumn("data_type", kind)


def field_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Kind of field by name, else by the share of values that look like it."""
    columns = columns or df.columns

    def named(column: str) -> str | None:
        low = column.lower()
        return next((kind for kind, hints in FIELD_HINTS if any(h in low for h in hints)), None)

    every = [_share(F.trim(F.col(c).cast("string")), F.trim(F.col(c).cast("string")).rlike(p)).alias(f"{c}__{k}") for c in columns for k, p, _ in VALUE_PATTERNS]
    out = unpivoted(df.agg(*every), columns, [k for k, _, _ in VALUE_PATTERNS])
    kind = F.lit("text")
    for k, _, least in reversed(VALUE_PATTERNS):
        kind = F.when(F.col(k) > least, k).otherwise(kind)
    for c in columns:
        if hint := named(c):
            kind = F.when(F.col("column") == c, hint).otherwise(kind)
    return out.withColumn("field_type", kind)


def semantic_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Business type by name, storage type, or over 0.8 of the values; long_text from 50 characters on average."""
    columns = columns or df.columns
    every = []
    for c in columns:
        x = F.col(c).cast("string")
        every += [_share(x, x.rlike(p)).alias(f"{c}__{k}") for k, p in (("phone", PHONE), ("email", K.EMAIL), ("id_card", ID_NUMBER), ("credit_code", K.CREDIT_CODE))]
        every += [_share(x, x.try_cast("timestamp").isNotNull()).alias(f"{c}__date"), F.avg(F.length(x)).alias(f"{c}__length"), F.count(x).alias(f"{c}__n")]
    out = unpivoted(df.agg(*every), columns, ["phone", "email", "id_card", "credit_code", "date", "length", "n"])
    kind = F.when(F.col("n") == 0, "unknown")
    for k in ("phone", "email", "id_card", "credit_code", "date"):
        kind = kind.when(F.col(k) > 0.8, k)
    kind = kind.when(F.col("length") > 50, "long_text").otherwise("text")
    for c in columns:
        data = df.schema[c].dataType
        stored = "integer" if isinstance(data, T.ByteType | T.ShortType | T.IntegerType | T.LongType) else "numeric" if isinstance(data, NUMERIC) else None
        hint = next((k for k, hints in NAME_HINTS.items() if any(h in c.lower() for h in hints)), stored)
        if hint:
            kind = F.when(F.col("column") == c, hint).otherwise(kind)
    return out.select("column", kind.alias("semantic_type"))


def field_roles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shares of a column's values that look like organisations, persons, places, identifiers, and the roles those
    make (over 0.3, 0.5, 0.3, 0.8)."""
    columns = columns or df.columns
    looks = {"organisation": f"({ORGANISATION_WORDS})", "person": f"^[{CJK}]{{2,4}}$|^[A-Za-z ]+ [A-Za-z ]+$", "place": f"({PLACE_HINTS})", "identifier": f"{K.CREDIT_CODE}|{ID_NUMBER}|{PHONE}"}
    limits = {"organisation": 0.3, "person": 0.5, "place": 0.3, "identifier": 0.8}
    every = [_share(F.col(c).cast("string"), F.col(c).cast("string").rlike(p)).alias(f"{c}__{k}") for c in columns for k, p in looks.items()]
    out = unpivoted(df.agg(*every), columns, list(looks))
    roles = F.array_compact(F.array(*[F.when(F.col(k) > least, k) for k, least in limits.items()]))
    return out.withColumn("roles", roles)


def content_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean company and address score of a column's values, and which of the two it is (over 0.3)."""
    every = []
    for c in columns:
        x = F.trim(F.col(c).cast("string"))
        n = F.length(x)

        def hits(pattern: str, x: Column = x) -> Column:
            return F.regexp_count(x, F.lit(pattern))

        company = F.when(x.rlike(f"({COMPANY_TAILS})$"), 0.8).otherwise(0.0) + F.least(F.lit(0.4), 0.1 * hits(ORGANISATION_WORDS)) + F.when(hits(PLACE_HINTS) > 2, -0.3).otherwise(0.0) + F.when(n.between(4, 50), 0.2).when(n > 50, -0.2).otherwise(0.0) + F.when(x.rlike("[0-9]{2,}"), -0.1).otherwise(0.0)
        place = F.least(F.lit(0.8), 0.15 * hits(PLACE_HINTS)) + F.when(x.rlike("[0-9]+号"), 0.3).otherwise(0.0) + F.when(x.rlike("[0-9]+[楼层]"), 0.2).otherwise(0.0) + F.when(x.rlike("[0-9]+室"), 0.2).otherwise(0.0)
        place = place + F.when(x.rlike("[^市]+市.*[区县]"), 0.4).when(x.rlike("[省市区县]"), 0.2).otherwise(0.0) + F.when(x.rlike(f"({COMPANY_TAILS})"), -0.4).otherwise(0.0) + F.when(n.between(8, 100), 0.1).when(n < 8, -0.2).otherwise(0.0)
        clamp = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) for s in (company, place)]
        every += [F.avg(F.when(n >= 1, F.when(n >= 2, clamp[0]).otherwise(0.0))).alias(f"{c}__company"), F.avg(F.when(n >= 1, F.when(n >= 3, clamp[1]).otherwise(0.0))).alias(f"{c}__address")]
    out = unpivoted(df.agg(*every), columns, ["company", "address"])
    a, b = F.coalesce("company", F.lit(0.0)), F.coalesce("address", F.lit(0.0))
    return out.withColumn("content", F.when((a > b) & (a > 0.3), "company_name").when((b > a) & (b > 0.3), "address").otherwise("unknown"))


def naming_patterns(columns: list[str]) -> dict[str, int]:
    """How many column names are written in each style."""
    import re

    styles = {"snake_case": r"^[a-z0-9]+(_[a-z0-9]+)+$", "camel_case": r"^[a-z]+([A-Z][a-z0-9]*)+$", "upper_case": r"^[A-Z0-9_]+$", "ideographs": f"[{CJK}]"}
    return {k: sum(bool(re.search(p, c)) for c in columns) for k, p in styles.items()}


def place_hierarchy(columns: list[str]) -> list[tuple[str, str]]:
    """Pairs (wider, narrower) of columns named after levels of places."""
    levels = (("国家", "country"), ("省", "province", "region"), ("市", "city", "nation"), ("区", "县", "district"), ("街道", "street"))
    found = [next((c for c in columns if any(w in c.lower() for w in words)), None) for words in levels]
    there = [c for c in found if c]
    return list(zip(there, there[1:], strict=False))


# --- validation -----------------------------------------------------------------------------------------------


def completeness(df: DataFrame) -> DataFrame:
    """Share of cells that are not null, and score min(1.2 * share, 1)."""
    cells = F.count("*") * len(df.columns)
    there = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    return df.agg(cells.alias("cells"), there.alias("non_null")).withColumn("completeness", ratio(F.col("non_null"), F.col("cells"))).withColumn("score", F.least(1.2 * F.col("completeness"), F.lit(1.0)))


def column_status(df: DataFrame) -> DataFrame:
    """good over 0.9, warning over 0.7, else poor, by the share of values that are there."""
    c = 1 - F.col("null_share")
    return counts(df).withColumn("completeness", c).withColumn("status", F.when(c > 0.9, "good").when(c > 0.7, "warning").otherwise("poor"))


def consistency(df: DataFrame) -> DataFrame:
    """1 less twice the share of duplicate rows (0.5 at most) and 0.1 for each numeric column stored as text (0.3)."""
    texts = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType)]
    wrong = numeric_as_text(df, texts).agg(F.count_if("numeric").alias("type_issues")) if texts else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("type_issues"))
    both = basics(df).crossJoin(wrong)
    share = ratio(F.col("duplicates"), F.col("rows"))
    score = F.greatest(F.lit(0.0), 1 - F.least(2 * share, F.lit(0.5)) - F.least(0.1 * F.col("type_issues"), F.lit(0.3)))
    return both.select("rows", "duplicates", "type_issues", score.alias("score"))


def validity(df: DataFrame, now: Column | None = None) -> DataFrame:
    """1 less twice the share of values that are wrong: e-mail and phone columns (by name) of another form, dates in
    the future or before 1900."""
    wrong = F.lit(0).cast("long")
    for c in df.columns:
        low, x = c.lower(), F.col(c).cast("string")
        if "email" in low or "邮箱" in c:
            wrong = wrong + F.count_if(~x.rlike(K.EMAIL))
        if "phone" in low or "电话" in c or "手机" in c:
            wrong = wrong + F.count_if(~x.rlike(PHONE))
        if any(h in low for h in ("date", "time", "时间", "日期")):
            t = x.try_cast("timestamp")
            wrong = wrong + F.count_if((t > (F.current_timestamp() if now is None else now)) | (t < F.to_timestamp(F.lit("1900-01-01"))))
    values = sum((F.count(F.col(c)) for c in df.columns), F.lit(0))
    out = df.agg(wrong.alias("issues"), values.alias("values"))
    return out.withColumn("score", F.greatest(F.lit(0.0), 1 - 2 * ratio(F.col("issues"), F.col("values"))))


def validation(df: DataFrame, now: Column | None = None) -> DataFrame:
    """completeness, consistency, validity, their mean, and whether the table is valid (completeness from 0.6)."""
    parts = [x.select(F.col("score").alias(n)) for n, x in (("completeness", completeness(df)), ("consistency", consistency(df)), ("validity", validity(df, now)))]
    both = reduce(DataFrame.crossJoin, parts)
    mean = (F.col("completeness") + F.col("consistency") + F.col("validity")) / 3
    return both.withColumn("overall", mean).withColumn("valid", F.col("completeness") >= 0.6)


def field_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Percent of values that are there, times 0.7 where under 1 % are distinct, 1.1 from 1 to 80 %, 100 at most."""
    columns = columns or df.columns
    every = []
    for c in columns:
        x = F.col(c).cast("string")
        there = F.when(x.isNotNull() & (x != "") & (x != "NaN"), x)
        every += [F.count("*").alias(f"{c}__rows"), F.count(there).alias(f"{c}__filled"), F.count_distinct(there).alias(f"{c}__unique_values")]
    out = unpivoted(df.agg(*every), columns, ["rows", "filled", "unique_values"])
    rate = F.round(100 * ratio(F.col("filled"), F.col("rows")))
    unique = ratio(F.col("unique_values"), F.col("rows"))
    quality = rate * F.when(unique < 0.01, 0.7).when(unique <= 0.8, 1.1).otherwise(1.0)
    return out.withColumn("filled_rate", rate).withColumn("quality", F.least(F.lit(100.0), F.round(quality)))


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The n most frequent values of each column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").filter("value is not null")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= n)

"""Knowledge graphs as two tables: entities (vertices) and triples (edges)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import tokens as K
from weftline.functions.normalize import CJK
from weftline.functions.values import filled, ratio, text
from weftline.session import shared_folder

# --- fixed values ---------------------------------------------------------------------------------------
ORGANISATION, PERSON, LOCATION, IDENTIFIER = "ORGANIZATION", "PERSON", "LOCATION", "IDENTIFIER"
LOCATED_IN, MANAGED_BY, CONTACT_OF, REPRESENTS, SIMILAR_TO = "LOCATED_IN", "MANAGED_BY", "CONTACT_OF", "REPRESENTS", "SIMILAR_TO"
COLUMN_HINTS = (
    (ORGANISATION, ("unit", "company", "corp", "公司", "单位", "机构", "企业")), (PERSON, ("person", "name", "manager", "姓名", "法人", "负责人", "经理")),
    (LOCATION, ("address", "location", "地址", "位置", "所在地")), (IDENTIFIER, ("id", "code", "phone", "tel", "编号", "代码", "电话")),
)
KEYWORDS = {
    ORGANISATION: ("公司", "企业", "集团", "有限", "股份", "合作社", "事务所", "中心", "机构"),
    PERSON: ("法人", "代表", "负责人", "经理", "主管", "董事", "总裁"),
    LOCATION: ("省", "市", "区", "县", "街道", "路", "号", "楼", "层"),
}
ORGANISATION_SUFFIXES = ("有限公司", "股份公司", "集团公司", "Co.Ltd", "Inc.", "Corp.", "LLC")
IDENTIFIERS = (K.CREDIT_CODE, "^[0-9]{15}$|^[0-9]{17}[0-9X]$", r"^(\+86)?1[3-9][0-9]{9}$|^[0-9]{3,4}-[0-9]{7,8}$")
RULES = {LOCATED_IN: ((ORGANISATION, PERSON), (LOCATION,), 0.8), MANAGED_BY: ((ORGANISATION,), (PERSON,), 0.9), CONTACT_OF: ((ORGANISATION, PERSON), (IDENTIFIER,), 0.7), REPRESENTS: ((PERSON,), (ORGANISATION,), 0.85)}
TRIGGERS = {
    LOCATED_IN: r"(.+?)(?:位于|坐落于|地址[:：]?|所在地[:：]?)(.+)", MANAGED_BY: r"(.+?)(?:由|被|法人[:：]?|负责人[:：]?)(.+?)(?:管理|负责|主管|$)",
    CONTACT_OF: r"(.+?)(?:联系电话|电话|手机|联系方式)[:：]?(.+)", REPRESENTS: r"(.+?)(?:法定代表人|法人代表|代表)(.+)", SIMILAR_TO: r"(.+?)(?:类似于|相似于)(.+)",
}
INVERSE, INVERSE_FACTOR = {MANAGED_BY: REPRESENTS, REPRESENTS: MANAGED_BY}, 0.9
TRANSITIVE = {LOCATED_IN: 0.8, SIMILAR_TO: 0.7}
FIELD_RELATIONS = ((LOCATED_IN, ("address", "地址")), (MANAGED_BY, ("manager", "负责", "法人")), (CONTACT_OF, ("phone", "contact", "电话")))
LEAST_CONFIDENCE, VIOLATION = 0.3, 0.5
TYPE_RULES = {  # pattern, least length, weight
    ORGANISATION: (("公司|企业|集团|有限|股份|合作社|事务所|中心|机构", 3, 0.8), ("学校|学院|大学|中学|小学|教育", 4, 0.9)),
    PERSON: ((f"^[{CJK}]{{2,4}}$", 2, 0.9), (r"^[A-Za-z\s]{2,50}$", 2, 0.8)),
    LOCATION: (("省|市|区|县|街道|路|号|楼|层", 3, 0.8),),
}
TYPE_SYNONYMS = {
    ORGANISATION: (
        "企业", "公司", "集团", "机构", "单位", "学院", "大学", "中学", "小学", "学校", "教育机构",
        "医疗机构", "诊所", "卫生院", "医院", "卫生所", "机关", "部门", "委员会", "政府", "行政机构",
    ),
    PERSON: ("管理者", "负责人", "主管", "经理", "领导", "法定代表人", "法人代表", "法人", "代表人", "负责人", "接洽人", "联系人", "对接人"),
    LOCATION: ("位置", "所在地", "地址", "住址", "场所", "注册地址", "登记地址", "注册地", "登记地"),
}
PATTERN_WEIGHT, SYNONYM_WEIGHT = 0.3, 0.2
RELATED_HINTS = {ORGANISATION: ("地址", "电话", "法人", "代表", "联系", "注册", "成立", "规模"), PERSON: ("电话", "邮箱", "职位", "部门", "年龄", "性别"), LOCATION: ("邮编", "区域", "经度", "纬度", "行政区")}
# --------------------------------------------------------------------------------------------------------


def entity_columns(columns: list[str]) -> dict[str, list[str]]:
    """Columns of each entity type by name; a column counts for the first type whose hint it has."""
    found: dict[str, list[str]] = {}
    for c in columns:
        kind = next((k for k, hints in COLUMN_HINTS if any(h in c.lower() for h in hints)), None)
        if kind:
            found.setdefault(kind, []).append(c)
    return found


def _has_any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def _number_of(x: Column, words: tuple[str, ...]) -> Column:
    return sum((x.contains(w).cast("int") for w in words), F.lit(0))


def valid_entity(x: Column, kind: str) -> Column:
    """Whether a text can be an entity of a type."""
    chinese, latin = x.rlike(f"^[{CJK}]{{2,4}}$"), x.rlike("^[A-Za-z ]{2,50}$") & x.contains(" ")
    rules = {
        ORGANISATION: ~x.rlike("^[0-9]+$") & x.rlike(f"[a-zA-Z{CJK}]") & ~x.isin("无", "空", "NULL", "null", "None", "-") & (_has_any(x, KEYWORDS[ORGANISATION]) | (F.length(x) >= 3)),
        PERSON: chinese | latin | _has_any(x, KEYWORDS[PERSON]),
        LOCATION: _has_any(x, KEYWORDS[LOCATION]),
        IDENTIFIER: reduce(lambda a, b: a | b, [x.rlike(p) for p in IDENTIFIERS]),
    }
    return (F.length(x) >= 2) & rules[kind]


def entity_confidence(x: Column, kind: str) -> Column:
    """0.3, plus half of what the type's rules find, adjusted for length, digits, marks, and repeated characters. The
    part that needs a tagger is left out."""
    rule = {
        ORGANISATION: F.when(reduce(lambda a, b: a | b, [x.endswith(s) for s in ORGANISATION_SUFFIXES]), 0.3).otherwise(0.0) + F.least(0.1 * _number_of(x, KEYWORDS[ORGANISATION]), F.lit(0.3)),
        PERSON: F.when(x.rlike(f"^[{CJK}]{{2,4}}$"), 0.4).when(x.rlike("^[A-Za-z ]{2,50}$") & x.contains(" "), 0.3).otherwise(0.0),
        LOCATION: F.least(0.15 * _number_of(x, KEYWORDS[LOCATION]), F.lit(0.4)),
        IDENTIFIER: F.when(reduce(lambda a, b: a | b, [x.rlike(p) for p in IDENTIFIERS]), 0.95).otherwise(0.0),
    }[kind]
    n = F.length(x)
    c = 0.3 + 0.5 * rule
    c = c * F.when(n < 3, 0.8).when(n > 50, 0.9).otherwise(1.0)
    if kind != IDENTIFIER:
        c = c * F.when(F.regexp_count(x, F.lit("[0-9]")) / n > 0.5, 0.7).otherwise(1.0)
        c = c * F.when(F.regexp_count(x, F.lit(rf"(?U)[^\w\s]|_")) / n > 0.3, 0.8).otherwise(1.0)
    c = c * F.when(F.size(K.characters(x)) / n < 0.3, 0.6).otherwise(1.0)
    return F.least(c, F.lit(1.0))


def type_score(x: Column, kind: str) -> Column:
    """How well a text fits a type: the heaviest pattern that it has and is long enough for, and the share of the type's
    synonyms in it, by their weights. The parts that need a tagger or samples are left out and the weights renormalised."""
    hits = [F.when((F.length(x) >= least) & x.rlike(p), weight).otherwise(0.0) for p, least, weight in TYPE_RULES.get(kind, ())]
    words = TYPE_SYNONYMS.get(kind, ())
    pattern = F.greatest(F.lit(0.0), *hits) if hits else F.lit(0.0)
    synonyms = _number_of(x, words) / max(len(words), 1)
    return (PATTERN_WEIGHT * pattern + SYNONYM_WEIGHT * synonyms) / (PATTERN_WEIGHT + SYNONYM_WEIGHT)


def text_entities(rows: DataFrame, record: str, column: str, name: str = "text_extraction", around: int = 20) -> DataFrame:
    """Entities named in texts: words that their own letters tell the type of, each once for a record and label in any
    case, with its first place in the text and so many characters on both sides. Null and empty texts name none; texts of
    equal ids count as one record. Words are runs of letters, digits, _ and -, as there is no tagger."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1)))
    each = rows.select(F.col(record).cast("string").alias("source_record_id"), F.col(column).alias("text"), F.explode(words).alias("label"))
    label = F.col("label")
    identifier = reduce(lambda a, b: a | b, [label.rlike(p) for p in IDENTIFIERS])
    kinds = {ORGANISATION: _has_any(label, KEYWORDS[ORGANISATION]), LOCATION: _has_any(label, KEYWORDS[LOCATION]), IDENTIFIER: identifier}

    def by_type(value: Callable[[str], Column]) -> Column:
        return reduce(lambda c, k: c.when(F.col("type") == k, value(k)), kinds, F)

    kind = reduce(lambda c, k: c.when(kinds[k], F.lit(k)), kinds, F)
    typed = each.withColumn("type", kind).filter("type IS NOT NULL").filter(by_type(lambda k: valid_entity(label, k)))
    at = F.instr("text", label)
    before = F.trim(F.substr("text", F.greatest(at - around, F.lit(1)), F.least(at - 1, F.lit(around))))
    after = F.trim(F.substr("text", at + F.length(label), F.lit(around)))
    found = F.struct(at.alias("at"), label, by_type(lambda k: entity_confidence(label, k)).alias("confidence"), before.alias("before"), after.alias("after"))
    first = typed.select("source_record_id", entity_id(F.col("type"), label).alias("id"), "type", found.alias("found")).groupBy("source_record_id", "id", "type").agg(F.min("found").alias("found"))
    return first.select(
        "id", "type", F.col("found.label").alias("label"), F.lit(name).alias("source_table"), F.lit(column).alias("source_column"), "source_record_id", F.col("found.confidence").alias("confidence"),
        (F.col("found.at") - 1).alias("text_position"), F.col("found.before").alias("context_before"), F.col("found.after").alias("context_after"),
    )


def projects(entities: DataFrame) -> DataFrame:
    """Entities of each named project."""
    return entities.filter(filled(F.col("project_name"))).groupBy("project_name").agg(F.count("*").alias("entity_count"))


def nodes(entities: DataFrame, kind: str | None = None, project: str | None = None, words: str | None = None) -> DataFrame:
    """Entities of a type and a project whose label holds a text in any case."""
    wanted = {"type": kind, "project_name": project}
    for column, value in wanted.items():
        if value is not None:
            entities = entities.filter(F.col(column) == value)
    return entities if words is None else entities.filter(F.lower("label").contains(words.lower()))


def property_key(name: str) -> str:
    import re

    return re.sub(rf"[^\w{CJK}]", "_", name).lower().strip("_")


def entity_id(kind: Column, label: Column) -> Column:
    """Ids by type and lower-case label: equal entities have equal ids, wherever they come from."""
    return F.left(F.md5(F.concat_ws(":", kind, F.lower(label))), F.lit(16))


def extracted(table: DataFrame, record: str, fields: dict[str, list[str]], name: str) -> DataFrame:
    """Entities of a table: for each type, the first of its columns gives the label, all of them properties. Columns:
    id, type, label, properties, source_table, source_column, source_record_id, confidence."""
    parts = []
    for kind, columns in fields.items():
        label = text(F.col(columns[0]))
        related = [c for c in table.columns if any(h in c.lower() for h in RELATED_HINTS.get(kind, ()))]
        entries = [F.struct(F.lit(property_key(c)).alias("key"), text(F.col(c)).alias("value")) for c in dict.fromkeys([*columns, *related])]
        properties = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] != ""))
        rows = table.filter(label != "").filter(valid_entity(label, kind))
        parts.append(rows.select(
            entity_id(F.lit(kind), label).alias("id"), F.lit(kind).alias("type"), label.alias("label"), properties.alias("properties"), F.lit(name).alias("source_table"),
            F.lit(columns[0]).alias("source_column"), F.col(record).cast("string").alias("source_record_id"), entity_confidence(label, kind).alias("confidence"),
        ))
    return reduce(DataFrame.unionByName, parts)


def merged_entities(entities: DataFrame) -> DataFrame:
    """One row per id: label and table of the first record, the properties of all (of equal keys the first record's),
    the largest confidence, how many records. Partial aggregates by id and key, so that an entity of very
    many records is no single list."""
    order = F.struct("source_table", "source_record_id", "label")
    base = entities.groupBy("id", "type").agg(F.min(order).alias("first"), F.max("confidence").alias("confidence"), F.count("*").alias("records"))
    each = entities.select("id", "type", order.alias("by"), F.explode("properties"))
    first = each.groupBy("id", "type", "key").agg(F.min_by("value", "by").alias("value"))
    maps = first.groupBy("id", "type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("properties"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return base.join(maps, ["id", "type"], "left").select("id", "type", F.col("first.label").alias("label"), F.coalesce("properties", none).alias("properties"), F.col("first.source_table").alias("source_table"), "confidence", "records")


def entity_summary(entities: DataFrame) -> DataFrame:
    """merged_entities without the properties: partial aggregates only, for entities of very many records."""
    return entities.groupBy("id", "type").agg(F.min("label").alias("label"), F.max("confidence").alias("confidence"), F.count("*").alias("records"))


def new_entities(entities: DataFrame, existing: DataFrame) -> DataFrame:
    return entities.join(existing.select("id"), "id", "left_anti")


def rule_triples(entities: DataFrame, relation: str, subject_column: str, object_column: str) -> DataFrame:
    """Triples between entities of one record, by a relation's rule: types and confidence."""
    subjects, objects, confidence = RULES[relation]
    keys = ["source_table", "source_record_id"]
    s = entities.filter(F.col("type").isin(*subjects) & (F.col("source_column") == subject_column)).select(*keys, F.col("id").alias("subject_id"), F.col("label").alias("subject_label"), F.col("type").alias("subject_type"))
    o = entities.filter(F.col("type").isin(*objects) & (F.col("source_column") == object_column)).select(*keys, F.col("id").alias("object_id"), F.col("label").alias("object_label"), F.col("type").alias("object_type"))
    both = s.join(o, keys)
    evidence = F.array(F.concat(F.lit(f"{subject_column}:"), F.col("subject_label")), F.concat(F.lit(f"{object_column}:"), F.col("object_label")))
    return both.select("subject_id", "subject_label", "subject_type", F.lit(relation).alias("predicate"), "object_id", "object_label", "object_type", F.lit(confidence).alias("confidence"), F.concat(F.lit("table:"), F.col("source_table")).alias("source"), evidence.alias("evidence"))


TRIPLE = ["subject_id", "subject_label", "subject_type", "predicate", "object_id", "object_label", "object_type", "confidence", "source", "evidence"]


def text_triples(texts: DataFrame, column: str, entities: DataFrame) -> DataFrame:
    """Relations stated in texts by trigger words, between entities whose labels stand on both sides."""
    named = entities.select("id", "label", "type").distinct()
    parts = []
    for relation, pattern in TRIGGERS.items():
        hit = texts.filter(F.col(column).rlike(pattern)).select(F.trim(F.regexp_extract(column, pattern, 1)).alias("a"), F.trim(F.regexp_extract(column, pattern, 2)).alias("b"), F.col(column).alias("said"))
        s = named.select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label"), F.col("type").alias("subject_type"))
        o = named.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"), F.col("type").alias("object_type"))
        both = hit.join(s, F.col("a") == F.col("subject_label")).join(o, F.col("b") == F.col("object_label"))
        parts.append(both.select("subject_id", "subject_label", "subject_type", F.lit(relation).alias("predicate"), "object_id", "object_label", "object_type", F.lit(0.6).alias("confidence"), F.lit("text").alias("source"), F.array(F.concat(F.lit("text:"), F.left("said", F.lit(100)))).alias("evidence")))
    return reduce(DataFrame.unionByName, parts)


def field_relation(subject_column: str, object_column: str) -> str | None:
    """What the names of two columns say about how their entities are related."""
    a, b = subject_column.lower(), object_column.lower()
    if not ("name" in b or "名称" in b):
        return None
    return next((relation for relation, hints in FIELD_RELATIONS if any(h in a for h in hints)), None)


def field_name_triples(entities: DataFrame, columns: list[str], similarity: Callable[[str, str], float], least: float = 0.7, factor: float = 0.8) -> DataFrame:
    """Triples between entities of one record whose columns have like names (over `least`), each column with those after it,
    where the names tell a relation. Only names are compared on the driver."""
    keys, parts = ["source_table", "source_record_id"], []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            relation, score = field_relation(a, b), similarity(a, b)
            if relation is None or score <= least:
                continue
            s, o = (entities.filter(F.col("source_column") == c).select(*keys, F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"), F.col("type").alias(f"{x}_type")) for c, x in ((a, "subject"), (b, "object")))
            both = s.join(o, keys)
            parts.append(both.select("subject_id", "subject_label", "subject_type", F.lit(relation).alias("predicate"), "object_id", "object_label", "object_type", F.lit(score * factor).alias("confidence"), F.concat(F.lit("field_semantics:"), "source_table").alias("source"), F.array(F.lit(f"field_similarity:{score:.3f}")).alias("evidence")))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    none = rule_triples(entities, LOCATED_IN, "", "").limit(0)
    return none.select(*TRIPLE)


def relation_types(triples: DataFrame) -> DataFrame:
    """A node for each relation type that occurs: what it may join, its inverse, whether it is symmetric or transitive, and the
    number and mean confidence of its triples. Upserted by relation_id."""
    known = {r: ("|".join(s), "|".join(o)) for r, (s, o, _) in RULES.items()}

    def of(values: dict[str, str]) -> Column:
        out = F.lit("")
        for k, v in values.items():
            out = F.when(F.col("predicate") == k, v).otherwise(out)
        return out

    rows = triples.groupBy("predicate").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    return rows.select(
        F.concat(F.lit("relation:"), "predicate").alias("relation_id"), F.col("predicate").alias("type"), of({k: v[0] for k, v in known.items()}).alias("domain"), of({k: v[1] for k, v in known.items()}).alias("range"),
        of(INVERSE).alias("inverse"), (F.col("predicate") == SIMILAR_TO).alias("is_symmetric"), F.col("predicate").isin(*TRANSITIVE).alias("is_transitive"), "n", "confidence",
    )


def search(entities: DataFrame, triples: DataFrame, words: str, kind: str = "all", limit: int = 20) -> DataFrame:
    """Entities whose label, and triples of which a part's label, holds a text in any case: (kind, id, label, confidence), the
    `limit` most confident of each kind, ties by id."""
    def holds(*columns: str) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(words.lower()) for c in columns])

    found = []
    if kind in ("entities", "all"):
        found.append(entities.filter(holds("label")).select(F.lit("entity").alias("kind"), "id", "label", "confidence"))
    if kind in ("relations", "all"):
        hit = triples.filter(holds("subject_label", "predicate", "object_label"))
        found.append(hit.select(F.lit("triple").alias("kind"), F.concat_ws("|", "subject_id", "predicate", "object_id").alias("id"), F.concat_ws(" ", "subject_label", "predicate", "object_label").alias("label"), "confidence"))
    best = [x.orderBy(F.desc("confidence"), "id").limit(limit) for x in found]
    return reduce(DataFrame.unionByName, best)


def similar_triples(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """SIMILAR_TO between organisations of like characters, each pair once. Labels are compared once each."""
    from weftline.operators.blocking import self_pairs

    labels = entities.filter(F.col("type") == ORGANISATION).groupBy("id").agg(F.min("label").alias("label"))
    rows = labels.select("id", K.characters(F.lower("label")).alias("tokens"))
    pairs = self_pairs(rows, least).filter(F.col("score") > least)
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"{x}_label")) for x in ("subject_id", "object_id"))
    both = pairs.select(F.col("a").alias("subject_id"), F.col("b").alias("object_id"), "score").join(a, "subject_id").join(b, "object_id")
    org = F.lit(ORGANISATION)
    return both.select("subject_id", F.col("subject_id_label").alias("subject_label"), org.alias("subject_type"), F.lit(SIMILAR_TO).alias("predicate"), "object_id", F.col("object_id_label").alias("object_label"), org.alias("object_type"), F.col("score").alias("confidence"), F.lit("similarity_analysis").alias("source"), F.array(F.format_string("similarity_score:%.3f", "score")).alias("evidence"))


def cooccurrence(entities: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of entities a < b by how many records hold both, and score min(n / 10, 1)."""
    once = entities.select("source_table", "source_record_id", "id").distinct()
    a, b = (once.select("source_table", "source_record_id", F.col("id").alias(x)) for x in "ab")
    pairs = a.join(b, ["source_table", "source_record_id"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.filter(F.col("n") >= least).withColumn("score", F.least(F.col("n") / 10, F.lit(1.0)))


def inverse(triples: DataFrame) -> DataFrame:
    """Triples that follow by turning a relation round."""
    to = F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])
    turned = triples.filter(F.col("predicate").isin(*INVERSE))
    return turned.select(
        F.col("object_id").alias("subject_id"), F.col("object_label").alias("subject_label"), F.col("object_type").alias("subject_type"), to[F.col("predicate")].alias("predicate"),
        F.col("subject_id").alias("object_id"), F.col("subject_label").alias("object_label"), F.col("subject_type").alias("object_type"),
        (F.col("confidence") * INVERSE_FACTOR).alias("confidence"), F.lit("inverse_inference").alias("source"), F.array(F.lit("inverse")).alias("evidence"),
    ).filter(F.col("confidence") >= LEAST_CONFIDENCE)


def transitive(triples: DataFrame) -> DataFrame:
    """Triples that follow in one hop, A to B to C, A not C."""
    factor = F.create_map(*[F.lit(x) for pair in TRANSITIVE.items() for x in pair])
    kept = triples.filter(F.col("predicate").isin(*TRANSITIVE))
    a = kept.select("subject_id", "subject_label", "subject_type", "predicate", F.col("object_id").alias("via"), F.col("object_label").alias("via_label"), F.col("confidence").alias("c1"))
    b = kept.select(F.col("subject_id").alias("via"), "predicate", "object_id", "object_label", "object_type", F.col("confidence").alias("c2"))
    both = a.join(b, ["via", "predicate"]).filter("subject_id <> object_id")
    confidence = F.least("c1", "c2") * factor[F.col("predicate")]
    return both.select("subject_id", "subject_label", "subject_type", "predicate", "object_id", "object_label", "object_type", confidence.alias("confidence"), F.lit("transitivity_inference").alias("source"), F.array(F.concat(F.lit("via:"), F.col("via_label"))).alias("evidence")).filter(F.col("confidence") >= LEAST_CONFIDENCE)


def type_consistent() -> Column:
    """Whether subject and object have types that the predicate's rule allows; other predicates allow all."""
    ok = F.lit(True)
    for relation, (subjects, objects, _) in RULES.items():
        ok = F.when(F.col("predicate") == relation, F.col("subject_type").isin(*subjects) & F.col("object_type").isin(*objects)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def constrained(triples: DataFrame, relation: str = MANAGED_BY) -> DataFrame:
    """Each wrong end of a relation halves the confidence; too small ones go."""
    subjects, objects, _ = RULES[relation]
    factor = F.when(F.col("subject_type").isin(*subjects), 1.0).otherwise(VIOLATION) * F.when(F.col("object_type").isin(*objects), 1.0).otherwise(VIOLATION)
    confidence = F.when(F.col("predicate") == relation, F.col("confidence") * factor).otherwise(F.col("confidence"))
    return triples.withColumn("confidence", confidence).filter((F.col("predicate") != relation) | (F.col("confidence") >= LEAST_CONFIDENCE))


def merged_triples(triples: DataFrame, most_evidence: int = 10) -> DataFrame:
    """One row per subject, predicate and object: the largest confidence and the smallest ten distinct evidences, which
    are ranked before they are gathered."""
    keys = ["subject_id", "predicate", "object_id"]
    first = [F.min(c).alias(c) for c in ("subject_label", "subject_type", "object_label", "object_type", "source")]
    base = triples.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.count("*").alias("times"), *first)
    said = triples.select(*keys, F.explode("evidence").alias("one")).distinct()
    few = said.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("one"))).filter(F.col("rn") <= most_evidence)
    lists = few.groupBy(*keys).agg(F.sort_array(F.collect_list("one")).alias("evidence"))
    return base.join(lists, keys, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def valid_triples(triples: DataFrame, ontology: DataFrame | None = None, first_subject_only: bool = False) -> DataFrame:
    """Triples of an ontology (predicate, domain, range), or of the rules; first_subject_only allows the first
    subject type of each rule alone."""
    if ontology is None:
        rows = [(p, s, o) for p, (subjects, objects, _) in RULES.items() for s in (subjects[:1] if first_subject_only else subjects) for o in objects]
        rows.append((SIMILAR_TO, ORGANISATION, ORGANISATION))
        ontology = triples.sparkSession.createDataFrame(rows, "predicate string, domain string, range string")
    allowed = ontology.withColumnsRenamed({"domain": "subject_type", "range": "object_type"})
    return triples.join(allowed, ["predicate", "subject_type", "object_type"], "left_semi")


def remapped(entities: DataFrame, types: dict[str, str], keys: dict[str, str]) -> DataFrame:
    """Entity types and property keys renamed."""
    out = entities.replace(types, subset=["type"]) if types else entities
    if keys:
        names = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
        out = out.withColumn("properties", F.transform_keys("properties", lambda k, v: F.coalesce(names[k], k)))
    return out


def build(tables: dict[str, tuple[DataFrame, str, dict[str, list[str]]]], relations: list[tuple[str, str, str]], least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of tables given as name -> (rows, record id, entity columns): extraction, rules, inference,
    constraints, and confidence."""
    entities = reduce(DataFrame.unionByName, [extracted(df, rid, fields, name) for name, (df, rid, fields) in tables.items()])
    found = reduce(DataFrame.unionByName, [rule_triples(entities, *r) for r in relations])
    every = found.unionByName(inverse(found)).unionByName(transitive(found))
    triples = merged_triples(valid_triples(constrained(every))).filter(F.col("confidence") >= least)
    return merged_entities(entities), triples


def edges(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples whose ends both exist."""
    ids = entities.select("id").distinct()
    return triples.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")


def pruned(entities: DataFrame) -> DataFrame:
    """Empty properties dropped."""
    return entities.withColumn("properties", F.map_filter("properties", lambda k, v: filled(v)))


def neighbours(triples: DataFrame, node: str) -> DataFrame:
    """Triples that start or end at a node."""
    return triples.filter((F.col("subject_id") == node) | (F.col("object_id") == node))


def column_relations(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """How columns of the source tables are related: count, mean confidence and predicates of each pair of columns."""
    where = entities.select("id", "source_table", "source_column").distinct()
    s, o = (where.select(F.col("id").alias(f"{x}_id"), F.concat_ws(".", "source_table", "source_column").alias(f"{x}_column")) for x in ("subject", "object"))
    both = triples.join(s, "subject_id").join(o, "object_id")
    return both.groupBy("subject_column", "object_column").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.array_sort(F.collect_set("predicate")).alias("predicates"))


def table_relations(columns: DataFrame) -> DataFrame:
    """The same for pairs of tables."""
    def table(c: str) -> Column:
        return F.substring_index(c, ".", 1)

    pairs = columns.groupBy(table("subject_column").alias("subject_table"), table("object_column").alias("object_table"))
    return pairs.agg(F.sum("n").alias("n"), F.avg("avg_confidence").alias("avg_confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("predicates")))).alias("predicates"))


# --- structure and quality ------------------------------------------------------------------------------------


def type_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def confidence_tiers(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rows.groupBy(F.when(c > 0.8, "high").when(c >= 0.6, "medium").otherwise("low").alias("tier")).agg(F.count("*").alias("n"))


def degrees(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_distribution(triples: DataFrame) -> DataFrame:
    return degrees(triples).groupBy("degree").agg(F.count("*").alias("nodes"))


def density(entities: DataFrame, triples: DataFrame) -> DataFrame:
    both = entities.agg(F.count_distinct("id").alias("nodes")).crossJoin(triples.agg(F.count("*").alias("edges")))
    return both.withColumn("density", ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)))


def triangles(triples: DataFrame) -> DataFrame:
    """Number of undirected triangles. Edges run from the node of the smaller degree, so that no node of very many
    edges lists all pairs of its neighbours."""
    flat = triples.filter("subject_id <> object_id").select(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).distinct()
    degree = flat.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    both = flat.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.join(out.withColumnRenamed("v", "w"), "u").filter("v < w")
    closing = flat.select(F.col("a").alias("v"), F.col("b").alias("w"))
    return wedge.join(closing, ["v", "w"]).agg(F.count("*").alias("triangles"))


def components(entities: DataFrame, triples: DataFrame, folder: str | None = None, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id that each entity is connected with.

    Labels spread along edges and then jump to their label's label, until none changes; each round is written to
    a folder that executors share (spark.checkpoint.dir unless given), which cuts the lineage."""
    import uuid

    spark = entities.sparkSession
    root = folder or shared_folder(spark)
    at = f"{root}/components-{uuid.uuid4().hex}"
    both = triples.select(F.col("subject_id").alias("u"), F.col("object_id").alias("v"))
    both = both.union(both.select("v", "u")).distinct()
    both.write.parquet(f"{at}/edges")
    both = spark.read.parquet(f"{at}/edges")
    now = entities.select("id", F.col("id").alias("component")).distinct()
    for i in range(most_rounds):
        near = both.join(now, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("low"))
        spread = now.join(near, F.col("id") == F.col("u"), "left").select("id", F.least("component", F.coalesce("low", "component")).alias("component"), F.col("component").alias("before"))
        jump = spread.select(F.col("id").alias("j"), F.col("component").alias("to"))
        after = spread.join(jump, F.col("component") == F.col("j"), "left").select("id", F.least("component", F.coalesce("to", "component")).alias("component"), "before")
        after.write.parquet(f"{at}/{i}")
        after = spark.read.parquet(f"{at}/{i}")
        if after.filter("component <> before").isEmpty():
            return after.select("id", "component")
        now = after.select("id", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def connectivity(found: DataFrame) -> DataFrame:
    """Number of components, the largest one, and its share of all nodes."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), ratio(F.max("n"), F.sum("n")).alias("connectivity"))


def daily(rows: DataFrame, created: str) -> DataFrame:
    return rows.groupBy(F.to_date(created).alias("day")).agg(F.count("*").alias("n"))


def entity_quality(entities: DataFrame, least: float = 0.7) -> DataFrame:
    """0.4 mean confidence, 0.3 share of confident ones, 0.2 complete, 0.1 unique, over all entities."""
    complete = filled(F.col("label")) & F.col("type").isNotNull() & (F.size("properties") > 0)
    one = entities.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg((F.col("confidence") >= least).cast("double")).alias("high"), F.avg(complete.cast("double")).alias("complete"), F.count_distinct(F.concat_ws(":", "type", F.lower("label"))).alias("keys"))
    unique = ratio(F.col("keys"), F.col("n"))
    return one.select("n", "mean", "high", "complete", unique.alias("unique_share"), (0.4 * F.col("mean") + 0.3 * F.col("high") + 0.2 * F.col("complete") + 0.1 * unique).alias("score"))


def relation_quality(triples: DataFrame, least: float = 0.6) -> DataFrame:
    """0.4 mean confidence, 0.3 type-consistent, 0.2 complete, 0.1 confident."""
    complete = F.col("subject_id").isNotNull() & F.col("predicate").isNotNull() & F.col("object_id").isNotNull() & F.col("confidence").isNotNull()
    one = triples.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg(type_consistent().cast("double")).alias("consistent"), F.avg(complete.cast("double")).alias("complete"), F.avg((F.col("confidence") >= least).cast("double")).alias("high"))
    return one.withColumn("score", 0.4 * F.col("mean") + 0.3 * F.col("consistent") + 0.2 * F.col("complete") + 0.1 * F.col("high"))


def triple_quality(triples: DataFrame, least: float = 0.5) -> DataFrame:
    """0.4 mean confidence, 0.3 complete, 0.2 evidence (number and variety), 0.1 confident."""
    complete = F.col("subject_id").isNotNull() & F.col("predicate").isNotNull() & F.col("object_id").isNotNull()
    kinds = F.size(F.array_distinct(F.transform(F.filter("evidence", lambda e: e.contains(":")), lambda e: F.substring_index(e, ":", 1))))
    evidence = F.when(F.size("evidence") > 0, (F.least(F.size("evidence") / 3, F.lit(1.0)) + F.least(kinds / 2, F.lit(1.0))) / 2).otherwise(0.0)
    one = triples.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.avg(complete.cast("double")).alias("complete"), F.avg(evidence).alias("evidence"), F.avg((F.col("confidence") >= least).cast("double")).alias("high"))
    return one.withColumn("score", 0.4 * F.col("mean") + 0.3 * F.col("complete") + 0.2 * F.col("evidence") + 0.1 * F.col("high"))


def structure(entities: DataFrame, triples: DataFrame, folder: str | None = None) -> DataFrame:
    """0.3 connectivity, 0.25 density times ten, 0.25 triangles of all node triples, 0.2 over the logarithm of the
    number of nodes."""
    parts = density(entities, triples).crossJoin(triangles(triples)).crossJoin(connectivity(components(entities, triples, folder)))
    n = F.col("nodes").cast("double")
    clustering = ratio(F.col("triangles"), n * (n - 1) * (n - 2) / 6)
    path = F.when(n > 1, F.log(n)).otherwise(1.0)
    score = 0.3 * F.col("connectivity") + 0.25 * F.least(F.col("density") * 10, F.lit(1.0)) + 0.25 * clustering + 0.2 / F.greatest(path, F.lit(1.0))
    return parts.withColumn("clustering", clustering).withColumn("path_length", path).withColumn("score", score)


def graph_consistency(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """0.3 references that exist, 0.3 type-consistent, 0.2 numeric properties that are numbers, 0.2 timestamps in order
    (all of them where no table has any)."""
    used = triples.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    there = used.join(entities.select("id").distinct().withColumn("__there", F.lit(1)), "id", "left")
    references = there.agg(F.coalesce(F.avg(F.coalesce("__there", F.lit(0)).cast("double")), F.lit(1.0)).alias("reference_share"))
    types = triples.agg(F.coalesce(F.avg(type_consistent().cast("double")), F.lit(0.0)).alias("type_share"))
    numeric = F.forall(F.map_entries("properties"), lambda e: ~F.lower(e["key"]).isin("confidence", "score", "weight") | e["value"].try_cast("double").isNotNull())
    data = entities.agg(F.coalesce(F.avg(numeric.cast("double")), F.lit(0.0)).alias("data_share"))
    ordered = F.avg((F.col("created_time") <= F.col("updated_time")).cast("double")) if {"created_time", "updated_time"} <= set(entities.columns) else F.lit(1.0)
    times = entities.agg(F.coalesce(ordered, F.lit(1.0)).alias("time_share"))
    both = references.crossJoin(types).crossJoin(data).crossJoin(times)
    return both.withColumn("score", 0.3 * F.col("reference_share") + 0.3 * F.col("type_share") + 0.2 * F.col("data_share") + 0.2 * F.col("time_share"))


def overall_quality(accuracy: Column, complete: Column, consistent: Column, timely: Column, structural: Column) -> Column:
    return 0.3 * accuracy + 0.25 * complete + 0.25 * consistent + 0.1 * timely + 0.1 * structural


def recommendations(scores: DataFrame, least: float = 0.7) -> DataFrame:
    """(dimension, score) -> what to look at, for scores below `least`."""
    return scores.filter(F.col("score") < least).withColumn("recommendation", F.concat(F.lit("improve "), F.col("dimension")))

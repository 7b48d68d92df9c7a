"""Field mappings between tables: suggestion, application, and linkage by a mapping."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import fuzzy
from weftline.functions import similarity as S
from weftline.functions import tokens as T
from weftline.functions.address import address_similarity
from weftline.functions.names import intelligent_udf
from weftline.functions.values import is_empty, present
from weftline.operators import blocking, scoring

#: Words of field names by meaning, and how well types go together.
MEANINGS = {
    "name": ("name", "名称", "mc", "title"), "address": ("address", "addr", "地址", "dz", "位置"), "person": ("person", "people", "legal", "法人", "联系人", "负责人", "representative"),
    "phone": ("phone", "tel", "mobile", "电话", "手机", "dh"), "code": ("code", "credit", "代码", "编码", "no"), "date": ("date", "time", "日期", "时间", "sj"), "id": ("id", "key", "编号"),
}
TYPE_FAMILIES = (({"number", "integer", "float", "decimal", "numeric", "bigint", "int", "double"}, 0.9), ({"string", "text", "varchar", "char"}, 0.8), ({"date", "datetime", "timestamp", "time"}, 0.9), ({"boolean", "bool", "bit"}, 1.0))
TYPE_CROSSINGS = {("string", "number"): 0.3, ("string", "date"): 0.4, ("number", "string"): 0.5, ("date", "string"): 0.6}
NAME_WEIGHTS = {"characters": 0.2, "meaning": 0.3, "vector": 0.3, "history": 0.2}

#: Similarity functions by name: the extension point.
SIMILARITIES = {
    "text": S.containment, "exact_or_contained": S.exact_or_contained, "levenshtein": S.levenshtein, "characters": S.char_jaccard, "phone": S.phone_suffix,
    "number": S.numeric, "address": address_similarity, "unit_name": intelligent_udf, "blend": fuzzy.string_blend_udf, "slices": fuzzy.slice_blend_udf, "fuzzy_name": fuzzy.name_similarity,
}


def register(name: str, similarity) -> None:
    """Adds a similarity: (Column, Column) -> Column in [0, 1]."""
    SIMILARITIES[name] = similarity


@dataclass(frozen=True)
class Mapping:
    """A source field and the target field it is compared with."""

    source: str
    target: str
    kind: str = "text"
    weight: float = 1.0
    score: float = 0.7
    primary: bool = False
    target_table: str = ""

    def field(self) -> scoring.FieldScore:
        a, b = F.col(f"s_{self.source}"), F.col(f"t_{self.target}")
        return scoring.FieldScore(f"{self.source}->{self.target}", SIMILARITIES[self.kind](a.cast("string"), b.cast("string")), a, b, self.weight)


def _edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _grams(text: str) -> Counter:
    low = text.lower()
    return Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1))


def name_similarity(a: str, b: str, history: dict[str, list[str]] | None = None) -> float:
    """Of two field names: edit distance, meaning, character n-grams, and mappings used before."""
    a, b = a.strip().lower(), b.strip().lower()
    characters = 1.0 if a == b else 1 - _edit(a, b) / max(len(a), len(b), 1)
    left, right = ({k for k, words in MEANINGS.items() if any(w in x for w in words)} for x in (a, b))
    meaning = len(left & right) / len(left | right) if left and right else 0.0
    x, y = _grams(a), _grams(b)
    idf = {g: 1.0 if g in x and g in y else 1 + math.log(1.5) for g in x.keys() | y.keys()}
    norm = [math.sqrt(sum((n * idf[g]) ** 2 for g, n in v.items())) for v in (x, y)]
    vector = sum(n * y[g] * idf[g] ** 2 for g, n in x.items()) / (norm[0] * norm[1]) if all(norm) else 0.0
    used = 0.8 if b in [t.lower() for t in (history or {}).get(a, [])] else 0.0
    parts = {"characters": characters, "meaning": meaning, "vector": vector, "history": used}
    return sum(parts[k] * w for k, w in NAME_WEIGHTS.items())


def type_compatibility(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return next((score for family, score in TYPE_FAMILIES if a in family and b in family), TYPE_CROSSINGS.get((a, b), 0.1))


def suggestions(source: DataFrame, target: DataFrame, history: dict[str, list[str]] | None = None, keep: int = 3, least: float = 0.2) -> list[dict]:
    """For each source column its best target columns, by name (0.8) and type (0.2). Works on the schemas alone."""
    out = []
    for s in source.schema:
        scored = [(round(0.8 * name_similarity(s.name, t.name, history) + 0.2 * type_compatibility(s.dataType.simpleString(), t.dataType.simpleString()), 4), t.name) for t in target.schema]
        best = sorted((x for x in scored if x[0] > least), key=lambda x: (-x[0], x[1]))[:keep]
        out += [{"source_field": s.name, "target_field": name, "score": score, "rank": i + 1} for i, (score, name) in enumerate(best)]
    return out


def join_conditions(tables: dict[str, DataFrame], least: float = 0.6) -> list[dict]:
    """Pairs of columns of different tables that a join could use, by name and type."""
    names = sorted(tables)
    out = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            for s in tables[a].schema:
                for t in tables[b].schema:
                    score = 0.8 * name_similarity(s.name, t.name) + 0.2 * type_compatibility(s.dataType.simpleString(), t.dataType.simpleString())
                    if score >= least:
                        out.append({"left": f"{a}.{s.name}", "right": f"{b}.{t.name}", "score": round(score, 4)})
    return sorted(out, key=lambda x: (-x["score"], x["left"], x["right"]))


def applied(rows: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """Source columns under their target names."""
    return rows.select(*[F.col(m.source).alias(m.target) for m in mappings])


def coverage(rows: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """Share of values of each mapped column that are there."""
    wide = rows.agg(*[F.avg((~is_empty(F.col(m.source))).cast("double")).alias(m.source) for m in mappings])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(m.source).alias("source_field"), F.lit(m.target).alias("target_field"), F.col(m.source).alias("coverage")) for m in mappings])).alias("x")).select("x.*")


def key_fields(mappings: list[Mapping], side: str, most: int = 100) -> Column:
    """Map of the mapped fields' values, cut to `most` characters, for showing."""
    names = [getattr(m, side) for m in mappings]
    prefix = side[0]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.left(F.col(f"{prefix}_{n}").cast("string"), F.lit(most)) for n in names]))


def linked(source: DataFrame, target: DataFrame, mappings: list[Mapping], source_id: str, target_id: str, strategy: str = "fallback", least_shared: float = 0.3, keep: int = 10) -> DataFrame:
    """Links two tables by their mapping: pairs that share enough slices of any mapped field, scored by a strategy.

    fallback: fields that reach their mapping's score, over the weights of all, with a veto of weak primary fields.
    hierarchical: primary fields decide, secondary ones help in the middle. dual: every field must reach its
    threshold. simple: mean of equal, contained, or character similarity. Result: src, tgt, score, rank, matched_fields,
    confidence, match_type."""
    s = source.select(F.col(source_id).alias("src"), *[F.col(c).cast("string").alias(f"s_{c}") for c in dict.fromkeys(m.source for m in mappings)])
    t = target.select(F.col(target_id).alias("tgt"), *[F.col(c).cast("string").alias(f"t_{c}") for c in dict.fromkeys(m.target for m in mappings)])
    blocks = []
    for m in mappings:
        left = s.select("src", T.slices(F.lower(F.col(f"s_{m.source}"))).alias("tokens"))
        right = t.select("tgt", T.slices(F.lower(F.col(f"t_{m.target}"))).alias("tokens"))
        blocks.append(blocking.token_join(left, right, least_shared))
    pairs = blocking.candidate_union(*blocks).join(s, "src").join(t, "tgt")
    fields = [m.field() for m in mappings]
    names = [f"__f{i}" for i in range(len(fields))]
    pairs = pairs.withColumns({n: F.when(f.counts, f.score).otherwise(0.0) for n, f in zip(names, fields, strict=True)})
    done = [scoring.FieldScore(f.name, F.col(n), f.source, f.target, f.weight) for f, n in zip(fields, names, strict=True)]
    primary = [f for f, m in zip(done, mappings, strict=True) if m.primary]
    secondary = [f for f, m in zip(done, mappings, strict=True) if not m.primary]
    if strategy == "fallback":
        score = scoring.fallback_score(done, [m.score for m in mappings], [i for i, m in enumerate(mappings) if m.primary])
    elif strategy == "hierarchical":
        score = scoring.hierarchical_score(scoring.configured_score(primary), scoring.configured_score(secondary) if secondary else F.lit(0.0))
    elif strategy == "dual":
        checked = scoring.dual_validation(primary, secondary)
        score = F.when(checked["valid"], checked["score"])
    elif strategy == "simple":
        score = scoring.record_score([scoring.FieldScore(f.name, S.containment(f.source, f.target), f.source, f.target, 1.0) for f in done])
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    agreeing = F.array_compact(F.array(*[F.when(present(f.source, f.target) & (f.score >= max(m.score, 0.35)), F.lit(f.name)) for f, m in zip(done, mappings, strict=True)]))
    out = pairs.withColumn("score", score).withColumn("matched_fields", agreeing).filter(F.col("score") > 0)
    out = blocking.top(out, keep)
    return out.select("src", "tgt", "score", "rank", "matched_fields", scoring.confidence(F.col("score")).alias("confidence"), scoring.match_kind(F.col("score"), F.size("matched_fields")).alias("match_type"))

"""Scores of candidate pairs: weighted fields, adjustments, rules and bands. Expressions, with no join of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.values import is_empty, present, weighted_mean

# --- fixed values ---------------------------------------------------------------------------------------
FUZZY_WEIGHTS = {"unit_name": 0.4, "address": 0.4, "legal_person": 0.1, "security_person": 0.1}
ENHANCED_WEIGHTS = {"unit_name": 0.5, "address": 0.35, "legal_person": 0.1, "security_person": 0.05}
PRIORITY_WEIGHTS = (1.0, 0.8, 0.6, 0.4)
CONFIDENCE_BANDS = ((0.9, "very_high"), (0.8, "high"), (0.7, "medium"), (0.6, "low"))
HYBRID_CLAMP = (0.1, 0.95)
HYBRID_WEIGHTS = {
    "performance": {"optimized_fuzzy": 0.7, "fuzzy": 0.2, "intelligent": 0.1, "enhanced": 0.0},
    "accuracy": {"intelligent": 0.5, "enhanced": 0.3, "fuzzy": 0.2, "optimized_fuzzy": 0.0},
    "balanced": {"intelligent": 0.4, "optimized_fuzzy": 0.3, "enhanced": 0.2, "fuzzy": 0.1},
    "interactive": {"intelligent": 0.4, "enhanced": 0.3, "optimized_fuzzy": 0.2, "fuzzy": 0.1},
    "audit": {"intelligent": 0.4, "enhanced": 0.4, "fuzzy": 0.2, "optimized_fuzzy": 0.0},
}
HYBRID_HIGH = {"intelligent": 1.2, "optimized_fuzzy": 0.8}
HYBRID_LOW = {"fuzzy": 1.3, "enhanced": 1.2, "intelligent": 0.7}
HYBRID_MODE_SHIFT = {"performance": -0.05, "accuracy": 0.1, "balanced": 0.0, "interactive": 0.05, "audit": 0.15}
DUAL = {"primary": 0.25, "secondary": 0.25, "final": 0.35, "critical": 0.4, "synonym_factor": 0.4, "synonym_least": 0.15}
CARE_SYNONYMS = (("养老院", "护理院"), ("老年护理院", "养老院"), ("护理中心", "养老院"))
# --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldScore:
    """A field's similarity, both sides' values, and its weight."""

    name: str
    score: Column
    source: Column
    target: Column
    weight: float
    always: bool = False

    @property
    def counts(self) -> Column:
        return F.lit(True) if self.always else present(self.source, self.target)


def record_score(fields: list[FieldScore]) -> Column:
    """Weighted mean over the fields that both sides have (and those that always count)."""
    return weighted_mean([(f.score, f.counts, f.weight) for f in fields])


def configured_score(fields: list[FieldScore]) -> Column:
    """Weighted mean over all fields; a missing side scores 0."""
    return weighted_mean([(F.when(present(f.source, f.target), f.score).otherwise(0.0), F.lit(True), f.weight) for f in fields])


def agreement_boost(score: Column, name: Column, address: Column, boost: float = 0.15) -> Column:
    """Close name and address add to the score."""
    return F.least(F.lit(1.0), score + F.when((name >= 0.8) & (address >= 0.7), boost).otherwise(0.0))


def dynamic_threshold(n_fields: Column) -> Column:
    return F.when(n_fields == 1, 0.95).when(n_fields == 2, 0.85).otherwise(0.75)


def enhanced_score(score: Column, core: Column, conflict: Column, name: Column, address: Column, core_a: Column, core_b: Column) -> Column:
    """The adjustments in their order: like cores boost, a business conflict costs, a like name with another address
    is capped, unlike cores cost, a short core with a difference costs more, and unlike cores cap."""
    # each step uses the score before it once: nested copies would double the expression at every step
    zero, one = F.lit(0.0), F.lit(1.0)
    short = F.least(F.length(core_a), F.length(core_b))
    differs = ~is_empty(core_a) & ~is_empty(core_b) & (short <= 3) & (core < 0.95) & (F.left(core_a, short) != F.left(core_b, short))
    x = F.least(one, score * F.when(core >= 0.9, 1.5).otherwise(1.0))
    x = F.greatest(zero, x - F.when(conflict, 0.3).otherwise(0.0))
    x = F.least(x, F.when((name >= 0.8) & (address < 0.4), 0.6).otherwise(1.0))
    x = F.greatest(zero, x - F.when(core < 0.7, 0.2).otherwise(0.0))
    x = F.greatest(zero, x - F.when(differs, 0.5).otherwise(0.0))
    return F.least(x, F.when(core < 0.8, 0.5).otherwise(1.0))


def slice_score(ratio: Column, token_sort: Column, slices: Column, keywords: Column) -> Column:
    """0.4, 0.3, 0.2, 0.1, renormalised over the parts that are not null."""
    parts = [(ratio, 0.4), (token_sort, 0.3), (slices, 0.2), (keywords, 0.1)]
    return weighted_mean([(F.coalesce(p, F.lit(0.0)), p.isNotNull(), w) for p, w in parts])


def priority_weight(mapping_score: Column) -> Column:
    """Weight of a field by the score of its mapping."""
    a, b, c, d = PRIORITY_WEIGHTS
    return F.when(mapping_score >= 0.8, a).when(mapping_score >= 0.6, b).when(mapping_score >= 0.4, c).otherwise(d)


def hierarchical_score(primary: Column, secondary: Column, high: float = 0.9, medium: float = 0.6, primary_share: float = 0.7) -> Column:
    """A high primary score stands; a medium one is combined with the secondary fields; a lower one drops the pair
    (null)."""
    combined = F.least(F.lit(1.0), primary * primary_share + F.coalesce(secondary, F.lit(0.0)) * (1 - primary_share))
    return F.when(primary >= high, primary).when(primary >= medium, combined)


def merged_thresholds(configs: list[dict[str, float]]) -> dict[str, float]:
    """Mean of the thresholds of several primary fields, defaults filled in."""
    defaults = {"high": 0.9, "medium": 0.6, "low": 0.3}
    return {k: sum(c.get(k, d) for c in configs) / len(configs) for k, d in defaults.items()} if configs else defaults


def vetoed(score: Column, primaries: list[Column], least: float = 0.4) -> Column:
    """With two primary fields or more, any below `least` makes the score 0."""
    if len(primaries) < 2:
        return score
    low = F.least(*primaries) < least
    return F.when(low, 0.0).otherwise(score)


def fallback_score(fields: list[FieldScore], mapping_scores: list[float] | None = None, primaries: list[int] = (), least: float = 0.35) -> Column:
    """Fields count where they reach their mapping's score (0.7 unless given; `least` at least), over the weights of
    all; two primary fields or more must each reach 0.4; a total below `least` is 0."""
    asked = [max(x, least) for x in mapping_scores or [0.7] * len(fields)]
    scores = [F.when(f.counts, f.score).otherwise(0.0) for f in fields]
    total = sum(f.weight for f in fields)
    mean = sum((F.when(f.counts & (s >= a), s * f.weight).otherwise(0.0) for f, s, a in zip(fields, scores, asked, strict=True)), F.lit(0.0)) / total
    mean = vetoed(mean, [scores[i] for i in primaries])
    return F.when(mean >= least, mean).otherwise(0.0)


def address_filter(score: Column, address: Column, source: Column, target: Column, strict: float = 0.3, least: float = 0.4) -> Column:
    """Whether a pair stays: an address is missing, or the addresses are not too unlike and the blend is enough."""
    return ~present(source, target) | ((address >= strict) & (0.6 * score + 0.4 * address >= least))


def synonym_threshold(a: Column, b: Column, threshold: float = DUAL["primary"]) -> Column:
    """Lower where the names hold two words for one kind of home."""
    synonym = F.lit(False)
    for x, y in CARE_SYNONYMS:
        synonym = synonym | (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    return F.when(synonym, max(DUAL["synonym_least"], threshold * DUAL["synonym_factor"])).otherwise(threshold)


def dual_validation(primary: list[FieldScore], secondary: list[FieldScore]) -> Column:
    """Struct (valid, score): every field must be there and reach its threshold; two primary fields or more must
    each reach the critical one; the weighted mean of all must reach the final one."""
    every = [*primary, *secondary]
    valid = F.lit(True)
    for f in primary:
        valid = valid & present(f.source, f.target) & (f.score >= synonym_threshold(f.source.cast("string"), f.target.cast("string")))
        if len(primary) >= 2:
            valid = valid & (f.score >= DUAL["critical"])
    for f in secondary:
        valid = valid & present(f.source, f.target) & (f.score >= DUAL["secondary"])
    mean = weighted_mean([(f.score, F.lit(True), f.weight) for f in every])
    ok = F.coalesce(valid, F.lit(False)) & (mean >= DUAL["final"])
    return F.struct(ok.alias("valid"), F.when(F.coalesce(valid, F.lit(False)), mean).otherwise(0.0).alias("score"))


def house_number_gap(a: Column, b: Column, most: int = 50) -> Column:
    """Whether the first house numbers of two addresses lie too far apart to be one place."""
    x, y = (F.regexp_extract(v, "([0-9]+)号", 1).try_cast("int") for v in (a, b))
    return F.coalesce(F.abs(x - y) > most, F.lit(False))


def conflicting_words(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Whether one name has one word of a pair and the other name the other."""
    hit = F.lit(False)
    for x, y in pairs:
        hit = hit | (a.contains(x) & b.contains(y) & ~a.contains(y) & ~b.contains(x)) | (a.contains(y) & b.contains(x) & ~a.contains(x) & ~b.contains(y))
    return hit


def precheck(a: Column, b: Column, address: Column | None = None, least: float = 0.3) -> Column:
    """Cheap test before scoring: equal or one within the other regardless of case, like addresses, or enough shared
    characters of texts of three or more."""
    from weftline.functions.tokens import characters
    from weftline.functions.values import text

    x, y = F.lower(text(a)), F.lower(text(b))
    p, q = characters(x), characters(y)
    alike = (F.length(x) >= 3) & (F.length(y) >= 3) & (F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q), F.lit(1)) >= least)
    near = F.lit(False) if address is None else address >= least
    return (x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x) | near | alike)


def confidence(score: Column) -> Column:
    out = F.lit("very_low")
    for least, name in reversed(CONFIDENCE_BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def match_kind(score: Column, n_fields: Column) -> Column:
    """Kind of a match by its score and how many fields agree."""
    return (
        F.when((score >= 0.95) & (n_fields >= 3), "exact_match").when((score >= 0.8) & (n_fields >= 2), "strong_match")
        .when(score >= 0.7, "good_match").when(score >= 0.6, "weak_match").otherwise("poor_match")
    )


def result_type(method: Column, score: Column) -> Column:
    """Type of a linkage result: exact by code, perfect from 0.95, else fuzzy; none without a method."""
    return F.when(method == "credit_code", "exact_credit_code").when(method.isNull(), "none").when(score >= 0.95, "fuzzy_perfect").otherwise("fuzzy")


def decision(score: Column, accept: float = 0.85, suspect: float = 0.6) -> Column:
    return F.when(score >= accept, "accept").when(score >= suspect, "suspect").otherwise("reject")


def decision_confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("very_low")


def needs_review(match_type: Column, score: Column, least: float = 0.8) -> Column:
    return match_type.startswith("fuzzy") & (score < least)


def consistency(pairs: dict[str, tuple[Column, Column]], address_like: Column | None = None) -> Column:
    """Struct of flags: whether both sides' values agree, or one is missing; addresses may also be alike."""
    flags = []
    for name, (a, b) in pairs.items():
        same = ~present(a, b) | (a == b)
        if name == "address" and address_like is not None:
            same = same | address_like
        flags.append(F.coalesce(same, F.lit(False)).alias(name))
    return F.struct(*flags)


def hybrid(scores: dict[str, Column], mode: str, quality: Column) -> Column:
    """Struct (score, confidence, threshold, matched) of several algorithms' scores of a pair. Each mode weighs them;
    high quality data favours the intelligent one, low quality the fuzzy ones, weights renormalised.
    Confidence is the mean times consistency (1 - variance) plus a quality bonus."""
    base = HYBRID_WEIGHTS[mode]
    weights = {k: F.when(quality == "high", _adjusted(k, w, HYBRID_HIGH)).when(quality == "low", _adjusted(k, w, HYBRID_LOW)).otherwise(w) for k, w in base.items()}
    total = sum(weights.values(), F.lit(0.0))
    score = sum((scores[k] * w for k, w in weights.items()), F.lit(0.0)) / total
    used = [scores[k] for k, w in base.items() if w > 0]
    mean = sum(used, F.lit(0.0)) / len(used)
    variance = sum(((s - mean) * (s - mean) for s in used), F.lit(0.0)) / len(used)
    bonus = F.when(quality == "high", 0.1).when(quality == "medium", 0.05).otherwise(0.0)
    sure = F.least(F.lit(1.0), mean * F.greatest(F.lit(0.0), 1 - variance) + bonus)
    low, high = HYBRID_CLAMP
    asked = F.lit(0.75 + HYBRID_MODE_SHIFT[mode]) + F.when(quality == "high", 0.05).when(quality == "low", -0.1).otherwise(0.0)
    asked = F.greatest(F.lit(low), F.least(F.lit(high), asked))
    return F.struct(score.alias("score"), sure.alias("confidence"), asked.alias("threshold"), (score >= asked).alias("matched"))


def _adjusted(name: str, weight: float, factors: dict[str, float]) -> float:
    return min(1.0, weight * factors.get(name, 1.0))


def data_quality(filled: Column, name: Column) -> Column:
    """Quality of a pair's data by the share of filled fields; low where the name has under three characters."""
    return F.when(F.length(F.trim(name)) < 3, "low").when(filled >= 0.8, "high").when(filled >= 0.5, "medium").otherwise("low")

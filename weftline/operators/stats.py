"""Group statistics, pages, and searches over result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.values import filled, ratio, text


def by_type(results: DataFrame, kind: str, score: str) -> DataFrame:
    """Number and mean score of each type."""
    return results.groupBy(kind).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def folded(results: DataFrame, kind: str, score: str, prefixes: dict[str, str], fixed: dict[str, float] | None = None) -> DataFrame:
    """Types folded by prefix (first that fits, else 'none'), with the mean of the types' means weighted by their
    numbers; fixed means override."""
    typed = by_type(results.filter(F.col(kind).isNotNull()), kind, score)
    group = F.lit("none")
    for prefix, name in reversed(prefixes.items()):
        group = F.when(F.col(kind).startswith(prefix), name).otherwise(group)
    out = typed.groupBy(group.alias("kind")).agg(F.sum("n").alias("n"), ratio(F.sum(F.col("avg_score") * F.col("n")), F.sum(F.when(F.col("avg_score").isNotNull(), F.col("n")))).alias("avg_score"))
    for name, value in (fixed or {}).items():
        out = out.withColumn("avg_score", F.when(F.col("kind") == name, value).otherwise(F.col("avg_score")))
    return out


def match_rates(results: DataFrame, matched: Column, *groups: str) -> DataFrame:
    """Total, matched and rate in percent, for each value of each grouping column."""
    parts = [results.groupBy(F.lit(g).alias("dimension"), F.col(g).cast("string").alias("value")).agg(F.count("*").alias("total"), F.count_if(matched).alias("matched")) for g in groups]
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("rate", F.round(100 * ratio(F.col("matched"), F.col("total")), 2))


def overall(results: DataFrame, score: str, high: float = 0.8) -> DataFrame:
    """Mean, largest, smallest score and how many reach `high`."""
    s = F.col(score)
    return results.agg(F.count("*").alias("total"), F.avg(s).alias("avg_score"), F.max(s).alias("max_score"), F.min(s).alias("min_score"), F.count_if(s >= high).alias("high"))


def pair_rollup(results: DataFrame, a: str, b: str, score: str, condition: Column | None = None) -> DataFrame:
    """Number and mean score of each pair of values, of the rows that fulfil a condition."""
    rows = results if condition is None else results.filter(condition)
    return rows.groupBy(a, b).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score"))


def histogram(rows: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """Counts over [0, 1) in equal bins; all other values, 1 and null too, are in bin -1."""
    bin_ = F.when((value >= 0) & (value < 1), F.floor(value * bins)).otherwise(-1).cast("long")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Values that several rows have, and how many."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_total(rows: DataFrame, *keys: str) -> DataFrame:
    return duplicates(rows, *keys).agg(F.count("*").alias("duplicate_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def value_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def value_map(rows: DataFrame, column: str, most: int = 10) -> DataFrame:
    """One row: all values with their counts as a map where there are at most `most`, else null, and how many."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    few = counts.orderBy("value").limit(most + 1).agg(F.collect_list(F.struct("value", "n")).alias("entries"))
    total = counts.agg(F.count("*").alias("distinct_values"))
    return total.crossJoin(few).select("distinct_values", F.when(F.col("distinct_values") <= most, F.map_from_entries("entries")).alias("counts"))


def suffixes(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent last two and last three characters."""
    ends = F.array(F.right(column, F.lit(2)), F.right(column, F.lit(3)))
    parts = rows.filter(F.length(column) >= 2).select(F.explode(F.array_distinct(ends)).alias("suffix"))
    return parts.groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(n)


def dashboard(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    return reduce(DataFrame.crossJoin, [df.agg(F.count("*").alias(name)) for name, df in counts.items()])


def trailing_average(rows: DataFrame, time: str, value: str, seconds: int) -> DataFrame:
    """Mean of a metric over the window that ends with the newest row."""
    newest = rows.agg(F.max(time).alias("__newest"))
    recent = rows.crossJoin(newest).filter(F.col(time) >= F.col("__newest") - F.expr(f"interval {seconds} seconds"))
    return recent.agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"))


def precision_recall(pairs: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Precision, recall and F1 of labelled pairs."""
    n = pairs.agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def best_per_group(rows: DataFrame, group: str | list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    groups = [group] if isinstance(group, str) else group
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= k)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) under a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def search(rows: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Rows where any column matches a regular expression, regardless of case."""
    return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").rlike(f"(?i){pattern}"), F.lit(False)) for c in columns]))


def having_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.filter(F.col(column).startswith(prefix))


def containing_any(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text has any of the words, taken literally."""
    return rows.filter(reduce(lambda a, b: a | b, [F.col(column).contains(w) for w in words]))


def text_search(rows: DataFrame, id_col: str, column: str, query: str) -> DataFrame:
    """(id, score): number of the query's distinct words that a text has."""
    from weftline.functions.tokens import words

    asked = words(F.lit(query))
    found = F.size(F.array_intersect(words(F.col(column)), asked))
    return rows.select(F.col(id_col), found.cast("long").alias("score")).filter("score > 0")


def pending_review(results: DataFrame, newest: str, n: int = 100) -> DataFrame:
    """The newest fuzzy results that nobody has reviewed."""
    open_ = F.col("match_type").startswith("fuzzy") & (F.col("review_status").isNull() | (F.col("review_status") == "pending"))
    return results.filter(open_).orderBy(F.desc(newest)).limit(n)


def reviewed(results: DataFrame, decisions: DataFrame, key: str = "src") -> DataFrame:
    """Results with the review status of a decisions table (key, review_status, review_notes) written over."""
    new = decisions.select(F.col(key).alias("__key"), F.col("review_status").alias("__status"), F.col("review_notes").alias("__notes"))
    joined = results.join(new, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("review_status", F.coalesce("__status", "review_status")).withColumn("review_notes", F.coalesce("__notes", "review_notes")).drop("__key", "__status", "__notes")


def sampled(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows: a sampling operator, so the limit is its purpose."""
    return rows.orderBy(F.rand(seed)).limit(n)


# --- associations ---------------------------------------------------------------------------------------------


def associations(rows: DataFrame, key: str, score: Column, fields: list[str], strategy: str = "building_based") -> DataFrame:
    """Groups of two rows or more of one, not empty key: association_id, strategy, members, confidence (the largest
    score, 0 if none), quality (share of filled fields). Aggregates only, so a key of very many rows is summed up
    before the shuffle; association_records() has the rows."""
    share = sum((filled(F.col(f)).cast("int") for f in fields), F.lit(0)) / len(fields)
    grouped = rows.filter(text(F.col(key)) != "").groupBy(F.col(key).cast("string").alias("association_id"))
    out = grouped.agg(F.count("*").alias("members"), F.coalesce(F.max(score), F.lit(0.0)).alias("confidence"), F.avg(share).alias("quality"))
    return out.filter("members > 1").withColumn("strategy", F.lit(strategy))


def association_records(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows of associations, one each with its association_id: the nested list as a table."""
    return rows.join(groups.select("association_id"), F.col(key).cast("string") == F.col("association_id"))


def association_stats(groups: DataFrame) -> DataFrame:
    """Over all groups: how many, with records, their rate in percent, mean members and quality."""
    held = F.count_if(F.col("members") > 0)
    rate = F.round(100 * ratio(held, F.count("*")), 2)
    return groups.agg(F.count("*").alias("groups"), held.alias("with_records"), rate.alias("rate"), F.avg("members").alias("avg_members"), F.avg("quality").alias("avg_quality"))


def visit_history(rows: DataFrame, key: str, date: str) -> DataFrame:
    """Per key: its rows, first and last date, and dates per distinct date."""
    dates = F.count(date) / F.greatest(F.countDistinct(date), F.lit(1))
    return rows.groupBy(key).agg(F.count("*").alias("visits"), F.min(date).alias("earliest"), F.max(date).alias("latest"), dates.alias("frequency"))


def task_stats(tasks: DataFrame, seconds: str, candidates: str) -> DataFrame:
    """Over all tasks: how many, their mean time, candidates in all and on average."""
    return tasks.agg(F.count("*").alias("tasks"), F.avg(seconds).alias("avg_seconds"), F.sum(candidates).alias("candidates"), F.avg(candidates).alias("avg_candidates"))


def decision_stats(tasks: DataFrame, decision: str, seconds: str, before: str, after: str, decisions: tuple[str, ...] = ("match", "suspicious", "reject")) -> DataFrame:
    """Over all decided tasks: how many, the number and percentage of each decision, mean time and scores."""
    each = [F.count_if(F.col(decision) == d) for d in decisions]
    shares = [(100 * ratio(n, F.count("*"))).alias(f"{d}_rate") for n, d in zip(each, decisions, strict=True)]
    means = [F.avg(c).alias(f"avg_{c}") for c in (seconds, before, after)]
    return tasks.agg(F.count("*").alias("tasks"), *[n.alias(d) for n, d in zip(each, decisions, strict=True)], *shares, *means)


def multi_match_stats(summary: DataFrame) -> DataFrame:
    """Over per-source match numbers: sources, matched ones, records, mean matches, rates."""
    matched = F.count_if(F.col("total_matches") > 0)
    return summary.agg(
        F.count("*").alias("sources"), matched.alias("matched"), F.count_if(F.col("total_matches") > 1).alias("several"), F.sum("total_matches").alias("records"),
        F.avg("total_matches").alias("avg_matches"), (100 * matched / F.greatest(F.count("*"), F.lit(1))).alias("match_rate"),
    )

"""Candidate pairs by shared tokens.

A pair is a candidate if the target has at least a share of the source's tokens. Not every shared token is joined:
of n tokens that must share m, at least k are among any n - m + k, so only the source's rarest n - m + k tokens are
looked up, the frequent ones hardly ever, and only pairs with k hits go on. Their overlap is then counted on the token
arrays. No pair is lost and no token is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tokens that a pair must share among those looked up (k above), where it must share that many at all.
HITS = 3
#: How many times the postings of the rarest tokens make others too dear to look up.
FAR_MORE = 4


def token_index(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, token) once for each distinct token: the inverted index as a table."""
    return rows.select(F.col(id_col), F.explode(F.array_distinct(tokens)).alias("token"))


def keyword_index(rows: DataFrame, id_col: str, fields: dict[str, str], table: str) -> DataFrame:
    """Index of several fields of a table, each with its kind: doc_id, source_table, field_name, field_type, keyword,
    original_value, preprocessed_value."""
    from weftline.functions.normalize import BY_KIND
    from weftline.functions.tokens import keywords

    def one(name: str, kind: str) -> DataFrame:
        value = F.col(name).cast("string")
        return rows.filter(value.isNotNull() & (value != "")).select(
            F.col(id_col).alias("doc_id"), F.lit(table).alias("source_table"), F.lit(name).alias("field_name"), F.lit(kind).alias("field_type"),
            F.explode(F.array_distinct(keywords(value, kind))).alias("keyword"), value.alias("original_value"), BY_KIND[kind](value).alias("preprocessed_value"),
        )

    return reduce(DataFrame.unionByName, [one(n, k) for n, k in fields.items()])


def token_join(source: DataFrame, target: DataFrame, least: float) -> DataFrame:
    """source (src, tokens), target (tgt, tokens), tokens distinct -> (src, tgt, hits, score), score = hits / number of
    the source's tokens, at least `least` (over 0).

    How many hits are asked for (k) is chosen by each source: HITS, or 1 where that many more tokens would be looked up in
    far more postings than the few of the rarest ones have."""
    n = F.size("tokens")
    needed = F.greatest(F.lit(1), F.ceil(n * F.lit(least) - 1e-9))
    most = F.least(needed, F.lit(HITS))
    postings = target.select("tgt", F.explode("tokens").alias("token"))
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    asked = source.filter(n > 0).select("src", (n - needed).alias("spare"), most.alias("most"), F.explode("tokens").alias("token")).join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = Window.partitionBy("src").orderBy("df", "token")
    whole = Window.partitionBy("src")
    ranked = asked.withColumn("rn", F.row_number().over(rarest))
    few, many = (F.sum(F.when(F.col("rn") <= F.col("spare") + k, F.col("df")).otherwise(0)).over(whole) for k in (F.lit(1), F.col("most")))
    ranked = ranked.withColumn("few", few).withColumn("many", many).withColumn("sure", F.when(F.col("few") * FAR_MORE <= F.col("many"), 1).otherwise(F.col("most")))
    looked = ranked.filter((F.col("rn") <= F.col("spare") + F.col("sure")) & (F.col("df") > 0)).select("src", "sure", "token")
    pairs = looked.join(postings, "token").groupBy("src", "tgt").agg(F.count("*").alias("c"), F.first("sure").alias("sure")).filter("c >= sure").select("src", "tgt")
    both = pairs.join(source.select("src", F.col("tokens").alias("a")), "src").join(target.select("tgt", F.col("tokens").alias("b")), "tgt")
    hits = F.size(F.array_intersect("a", "b"))
    return both.select("src", "tgt", hits.cast("long").alias("hits"), (hits / F.size("a")).alias("score")).filter(F.col("score") >= least - 1e-9)


def self_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Rows (id, tokens) -> (a, b, score), a < b, Jaccard of the tokens at least `least`. A Jaccard of j needs an
    overlap of j times the tokens of either side, so the side of the smaller id is looked up."""
    found = token_join(rows.select(F.col("id").alias("src"), "tokens"), rows.select(F.col("id").alias("tgt"), "tokens"), least).filter("src < tgt")
    sizes = rows.select("id", F.size("tokens").alias("n"))
    both = found.join(sizes.select(F.col("id").alias("src"), F.col("n").alias("na")), "src").join(sizes.select(F.col("id").alias("tgt"), F.col("n").alias("nb")), "tgt")
    jaccard = F.col("hits") / (F.col("na") + F.col("nb") - F.col("hits"))
    return both.select(F.col("src").alias("a"), F.col("tgt").alias("b"), jaccard.alias("score")).filter(F.col("score") >= least - 1e-9)


def top(pairs: DataFrame, k: int, by: str = "score", group: tuple[str, ...] = ("src",), tie: str = "tgt") -> DataFrame:
    """The k best rows of each group; ties by the smaller id."""
    order = Window.partitionBy(*group).orderBy(F.desc(by), tie)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidate_union(*found: DataFrame) -> DataFrame:
    """(src, tgt) of several joins, once each."""
    return reduce(DataFrame.unionByName, [f.select("src", "tgt") for f in found]).distinct()


def merged_candidates(slices: DataFrame, keywords: DataFrame) -> DataFrame:
    """Two scored joins side by side: (src, tgt, slice_score, keyword_score), null where one has no such pair."""
    left = slices.select("src", "tgt", F.col("score").alias("slice_score"))
    right = keywords.select("src", "tgt", F.col("score").alias("keyword_score"))
    return left.join(right, ["src", "tgt"], "full_outer")


def cascade(source: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """First step that finds anything for a source wins: (src, tgt, ..., step)."""
    found = None
    for name, pairs in steps:
        own = pairs.join(source.select("src"), "src", "left_semi").withColumn("step", F.lit(name))
        own = own if found is None else own.join(found.select("src").distinct(), "src", "left_anti")
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found


def prioritised(cap: int, *steps: DataFrame) -> DataFrame:
    """Candidates of several methods, best method first, at most cap for each source; a pair counts by its best method."""
    ranked = [s.select("src", "tgt", "score", F.lit(i).alias("priority")) for i, s in enumerate(steps)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("src", "tgt").agg(F.min("priority").alias("priority"), F.max("score").alias("score"))
    order = Window.partitionBy("src").orderBy("priority", F.desc("score"), "tgt")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def topped_up(first: DataFrame, more: DataFrame, enough: int = 3, keep: int = 5) -> DataFrame:
    """(src, tgt, score, step): the pairs of a first method; sources with fewer than `enough` of those also have the pairs
    of a second one that the first lacks; the best `keep` of each source."""
    own = first.select("src", "tgt", "score", F.lit("first").alias("step"))
    short = own.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
    extra = more.select("src", "tgt", "score", F.lit("more").alias("step")).join(short.select("src"), "src", "left_anti").join(own.select("src", "tgt"), ["src", "tgt"], "left_anti")
    return top(own.unionByName(extra.select("src", "tgt", "score", "step")), keep)

"""Registered queries: each operator over the driver's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import normalize as N
from weftline.functions import similarity as S
from weftline.functions import tokens as T
from weftline.operators import blocking, graph, incremental, linkage, profile, scoring, stats, tiles
from weftline.session import kept, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Columns of SQL literals, which would be decimals.
DOUBLES = {
    "contains_pair_score": ["contained"], "phone_rules": ["score"], "regex_field_types": ["phone", "email"], "kg_triples": ["confidence"], "kg_inverse": ["confidence"], "kg_transitive": ["confidence"],
    "kg_entity_quality": ["complete"], "kg_relation_quality": ["complete"], "kg_triple_quality": ["complete", "high"], "kg_field_names": ["confidence"], "kg_search": ["confidence"], "kg_relation_types": ["confidence"],
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DOUBLES.get(f.__name__, []))
            ORACLES[f.__name__] = f"SELECT * REPLACE ({doubles}) FROM ({sql})" if doubles else sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- linkage ------------------------------------------------------------------------------------------------

#: Distinct slices of a text, and the share of a's slices that b has, in SQL.
SLICES_SQL = """list_distinct(list_concat([k[i:i+1] for i in range(1, len(k))], [k[i:i+2] for i in range(1, len(k) - 1)]))"""
PART_SLICES_SQL = f"""
n AS (SELECT DISTINCT p_name FROM part),
k AS (SELECT p_name, regexp_replace(p_name, '[^a-zA-Z0-9_]', '', 'g') AS k FROM n),
s AS (SELECT p_name, {SLICES_SQL} AS g FROM k),
pairs AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / len(a.g) AS score, len(list_intersect(a.g, b.g)) AS hits FROM s a, s b WHERE len(a.g) > 0)
"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_name").distinct()


def name_pairs(spark: SparkSession, sf_dir: str, least: float = 0.3) -> DataFrame:
    """(src, tgt, hits, score) over the distinct part names."""
    names = part_names(spark, sf_dir)
    return blocking.token_join(names.select(F.col("p_name").alias("src"), T.slices(F.col("p_name")).alias("tokens")), names.select(F.col("p_name").alias("tgt"), T.slices(F.col("p_name")).alias("tokens")), least)


@query(f"""
WITH {PART_SLICES_SQL},
scored AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) END AS score FROM pairs WHERE score >= 0.3 - 1e-9 AND a <> b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM scored WHERE score >= 0.4),
best AS (SELECT * FROM ranked WHERE rn = 1)
SELECT p_partkey AS src, b AS matched_name, round(score, 6) AS score,
       CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.7 THEN 'medium' WHEN score >= 0.6 THEN 'low' ELSE 'very_low' END AS confidence
FROM part JOIN best ON p_name = a
""")
def link_part_names(spark, sf_dir):
    """Flagship: each part with the likest other name, by blocked slices, edit distance, and total order."""
    pairs = name_pairs(spark, sf_dir).filter("src <> tgt").withColumn("score", S.levenshtein(F.col("src"), F.col("tgt"))).filter("score >= 0.4")
    best = blocking.top(pairs, 1).select(F.col("src").alias("name"), F.col("tgt").alias("matched_name"), "score")
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), "p_name")
    return parts.join(best, F.col("p_name") == F.col("name")).select("src", "matched_name", r6("score").alias("score"), scoring.confidence(F.col("score")).alias("confidence"))


LABEL_SQL = """
l AS (SELECT p_partkey AS id, p_name || ' ' || CASE WHEN p_partkey % 6 = 1 THEN 'x' ELSE '' END || substr(md5(CAST(p_partkey // 2 AS VARCHAR)), 1, 12) AS name FROM part)"""


def part_labels(spark, sf_dir) -> DataFrame:
    """(id, name): a name of its own for each part, of which those of keys 2n and 2n + 1 share a serial number, one in three
    with a slip of the pen."""
    key = F.col("p_partkey")
    serial = F.left(F.md5(F.floor(key / 2).cast("long").cast("string").cast("binary")), F.lit(12))
    return t(spark, sf_dir, "part").select(key.alias("id"), F.concat("p_name", F.lit(" "), F.when(key % 6 == 1, "x").otherwise(""), serial).alias("name"))


@query(f"""
WITH {LABEL_SQL},
s AS (SELECT id, name, list_distinct([k[i:i+2] for i in range(1, len(k) - 1)]) AS g FROM (SELECT id, name, regexp_replace(name, '[^a-zA-Z0-9_]', '', 'g') AS k FROM l)),
tok AS (SELECT id, len(g) AS n, unnest(g) AS token FROM s),
hits AS (SELECT a.id AS src, b.id AS tgt, count(*) AS h, any_value(a.n) AS n FROM tok a JOIN tok b USING (token) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2),
pairs AS (SELECT src, tgt, a.name AS x, b.name AS y FROM hits JOIN l a ON a.id = src JOIN l b ON b.id = tgt WHERE h / n >= 0.5 - 1e-9),
scored AS (SELECT src, tgt, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE (greatest(len(x), len(y)) - levenshtein(x, y)) / greatest(len(x), len(y)) END AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rn FROM scored WHERE score >= 0.6)
SELECT src, tgt, round(score, 6) AS score FROM ranked WHERE rn = 1
""")
def link_part_labels(spark, sf_dir):
    """Parts of even keys with the likest of odd keys, by blocked 3-grams of as many distinct names as there are parts."""
    labels = part_labels(spark, sf_dir)
    s = labels.filter("id % 2 = 0").select(F.col("id").alias("src"), F.col("name").alias("s_name"))
    g = labels.filter("id % 2 = 1").select(F.col("id").alias("tgt"), F.col("name").alias("t_name"))
    pairs = tiles.tiled_join(s, g, (T.ngrams(F.col("s_name"), 3), T.ngrams(F.col("t_name"), 3)), 0.5)
    scored = pairs.withColumn("score", S.levenshtein(F.col("s_name"), F.col("t_name"))).filter("score >= 0.6")
    return blocking.top(scored, 1).select("src", "tgt", r6("score").alias("score"))


@query(f"WITH {PART_SLICES_SQL} SELECT a AS src, b AS tgt, hits, round(score, 6) AS score FROM pairs WHERE score >= 0.3 - 1e-9")
def ngram_block_join(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("src", "tgt", "hits", r6("score").alias("score"))


@query("""
WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]{2,}'), lambda x: true)) AS g FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]{2,}')) AS g FROM benchmark),
s AS (SELECT item_id AS src, doc_id AS tgt, len(list_intersect(b.g, w.g)) AS hits, len(list_intersect(b.g, w.g)) / len(b.g) AS score FROM b, w WHERE len(b.g) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS rank FROM s WHERE score >= 0.5 - 1e-9)
SELECT src, tgt, hits, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10
""")
def keyword_block_join(spark, sf_dir):
    """Top ten documents of each benchmark item by shared words."""
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z0-9]{2,})"), 1))
    s = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("src"), words.alias("tokens"))
    d = kept(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("tgt"), words.alias("tokens")), "tokens")  # read four times
    return blocking.top(blocking.token_join(s, d, 0.5), 10).select("src", "tgt", "hits", r6("score").alias("score"), "rank")


@query(f"""
WITH {PART_SLICES_SQL}, w AS (SELECT p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}')) AS g FROM n),
words AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / len(a.g) AS score FROM w a, w b WHERE len(a.g) > 0)
SELECT coalesce(x.a, y.a) AS src, coalesce(x.b, y.b) AS tgt, round(x.score, 6) AS slice_score, round(y.score, 6) AS keyword_score
FROM (SELECT * FROM pairs WHERE score >= 0.3 - 1e-9) x FULL JOIN (SELECT * FROM words WHERE score >= 0.5 - 1e-9) y ON x.a = y.a AND x.b = y.b
""")
def merged_candidates(spark, sf_dir):
    names = part_names(spark, sf_dir)
    words = names.select(F.col("p_name").alias("src"), T.words(F.col("p_name")).alias("tokens"))
    by_word = blocking.token_join(words, words.withColumnRenamed("src", "tgt"), 0.5)
    out = blocking.merged_candidates(name_pairs(spark, sf_dir), by_word)
    return out.select("src", "tgt", r6("slice_score").alias("slice_score"), r6("keyword_score").alias("keyword_score"))


@query(f"""
WITH {PART_SLICES_SQL}, w AS (SELECT p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}')) AS g FROM n),
words AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / len(a.g) AS score FROM w a, w b WHERE len(a.g) > 0),
every AS (SELECT a, b, score, 0 AS p FROM words WHERE score >= 0.5 - 1e-9 UNION ALL SELECT a, b, score, 1 FROM pairs WHERE score >= 0.3 - 1e-9),
best AS (SELECT a, b, min(p) AS p, max(score) AS score FROM every GROUP BY a, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY p, score DESC, b) AS rank FROM best)
SELECT a AS src, b AS tgt, CAST(p AS INTEGER) AS priority, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 30
""")
def prioritised_candidates(spark, sf_dir):
    names = part_names(spark, sf_dir)
    words = names.select(F.col("p_name").alias("src"), T.words(F.col("p_name")).alias("tokens"))
    by_word = blocking.token_join(words, words.withColumnRenamed("src", "tgt"), 0.5)
    out = blocking.prioritised(30, by_word, name_pairs(spark, sf_dir))
    return out.select("src", "tgt", "priority", r6("score").alias("score"), "rank")


@query(f"""
WITH {PART_SLICES_SQL}, w AS (SELECT p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}')) AS g FROM n),
own AS (SELECT a, b, score, 'first' AS step FROM pairs WHERE score >= 0.6 - 1e-9),
words AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / len(a.g) AS score FROM w a, w b WHERE len(a.g) > 0),
extra AS (SELECT a, b, score, 'more' AS step FROM words WHERE score >= 0.5 - 1e-9 AND a NOT IN (SELECT a FROM own GROUP BY a HAVING count(*) >= 3) AND NOT EXISTS (SELECT 1 FROM own WHERE own.a = words.a AND own.b = words.b)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM extra))
SELECT a AS src, b AS tgt, round(score, 6) AS score, step, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5
""")
def topped_up_candidates(spark, sf_dir):
    """Candidates by slices, topped up by shared words where they are few."""
    words = part_names(spark, sf_dir).select(F.col("p_name").alias("src"), T.words(F.col("p_name")).alias("tokens"))
    by_word = blocking.token_join(words, words.withColumnRenamed("src", "tgt"), 0.5)
    return blocking.topped_up(name_pairs(spark, sf_dir, 0.6), by_word).select("src", "tgt", r6("score").alias("score"), "step", "rank")


NAME_CROSS_SQL = "n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b FROM n a, n b WHERE a.p_name < b.p_name)"


def names_crossed(spark, sf_dir):
    """Pairs of the distinct part names, of which there are as many as adjectives times nouns."""
    names = part_names(spark, sf_dir)
    return names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))


@query(f"WITH {NAME_CROSS_SQL} SELECT a, b, round(CASE WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) END, 6) AS score FROM p")
def lev_similarity(spark, sf_dir):
    return names_crossed(spark, sf_dir).select("a", "b", r6(S.levenshtein(F.col("a"), F.col("b"))).alias("score"))


@query(f"WITH {NAME_CROSS_SQL} SELECT a, b, round(jaccard(a, b), 6) AS score FROM p")
def char_jaccard(spark, sf_dir):
    return names_crossed(spark, sf_dir).select("a", "b", r6(S.char_jaccard(F.col("a"), F.col("b"))).alias("score"))


@query(f"WITH {NAME_CROSS_SQL} SELECT a, b, round(CASE WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE jaccard(a, b) END, 6) AS score, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.7 ELSE 0.0 END AS contained FROM p")
def contains_pair_score(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return names_crossed(spark, sf_dir).select("a", "b", r6(S.containment(a, b)).alias("score"), S.exact_or_contained(a, b).alias("contained"))


@query(f"""
WITH RECURSIVE {NAME_CROSS_SQL},
r AS (SELECT a, b, 0 AS i, [0 FOR j IN range(0, len(b) + 1)] AS v FROM p
      UNION ALL
      SELECT a, b, i + 1, list_reduce(list_prepend([0], [[CASE WHEN b[j] = a[i + 1] THEN v[j] + 1 ELSE v[j + 1] END] FOR j IN range(1, len(b) + 1)]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])))
      FROM r WHERE i < len(a))
SELECT a, b, round(v[len(b) + 1] / greatest(len(a), len(b)), 6) AS score FROM r WHERE i = len(a)
""")
def lcs_similarity(spark, sf_dir):
    return names_crossed(spark, sf_dir).select("a", "b", r6(S.lcs_share(F.col("a"), F.col("b"))).alias("score"))


@query(f"""
WITH {NAME_CROSS_SQL}, s AS (SELECT a, b, jaccard(a, b) AS x, (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) AS y, CASE WHEN substr(a, 1, 1) = 's' THEN NULL ELSE substr(a, 1, 3) END AS za, substr(b, 1, 3) AS zb FROM p)
SELECT a, b, round(CASE WHEN za IS NULL THEN (0.4 * x + 0.4 * y) / 0.8 ELSE (0.4 * x + 0.4 * y + 0.2 * CASE WHEN za = zb THEN 1.0 ELSE 0.0 END) / 1.0 END, 6) AS score FROM s
""")
def weighted_record_score(spark, sf_dir):
    """Weights renormalised where a field is missing on one side."""
    a, b = F.col("a"), F.col("b")
    za, zb = F.when(~a.startswith("s"), F.left(a, F.lit(3))), F.left(b, F.lit(3))
    edit = (F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b)) / F.greatest(F.length(a), F.length(b))
    fields = [scoring.FieldScore("x", S.char_jaccard(a, b), a, b, 0.4), scoring.FieldScore("y", edit, a, b, 0.4), scoring.FieldScore("z", (za == zb).cast("double"), za, zb, 0.2)]
    return names_crossed(spark, sf_dir).select("a", "b", r6(scoring.record_score(fields)).alias("score"))


@query(f"""
WITH {NAME_CROSS_SQL}, s AS (SELECT a, b, jaccard(a, b) AS x, (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) AS y FROM p)
SELECT a, b, round(CASE WHEN x >= 0.9 THEN x WHEN x >= 0.6 THEN least(1.0, 0.7 * x + 0.3 * y) END, 6) AS hierarchical,
       round(CASE WHEN least(x, y) < 0.4 THEN 0.0 WHEN ((CASE WHEN x >= 0.7 THEN x ELSE 0 END) + (CASE WHEN y >= 0.7 THEN y ELSE 0 END)) / 2 < 0.35 THEN 0.0
                  ELSE ((CASE WHEN x >= 0.7 THEN x ELSE 0 END) + (CASE WHEN y >= 0.7 THEN y ELSE 0 END)) / 2 END, 6) AS fallback,
       0.6 * x + 0.4 * y >= 0.4 AND y >= 0.3 AS kept
FROM s
""")
def rule_scores(spark, sf_dir):
    """Hierarchical, fallback with veto, and post-filter on one pair of scores."""
    a, b = F.col("a"), F.col("b")
    x = S.char_jaccard(a, b)
    y = (F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b)) / F.greatest(F.length(a), F.length(b))
    fields = [scoring.FieldScore("x", F.col("x"), a, b, 1.0), scoring.FieldScore("y", F.col("y"), a, b, 1.0)]
    scored = names_crossed(spark, sf_dir).withColumn("x", x).withColumn("y", y)
    return scored.select("a", "b", r6(scoring.hierarchical_score(F.col("x"), F.col("y"))).alias("hierarchical"), r6(scoring.fallback_score(fields, primaries=[0, 1])).alias("fallback"), scoring.address_filter(F.col("x"), F.col("y"), a, b).alias("kept"))


@query("""
WITH s AS (SELECT o_orderkey AS tgt, o_custkey AS src, o_totalprice / max(o_totalprice) OVER () AS score, o_orderpriority FROM orders),
near AS (SELECT *, max(score) OVER (PARTITION BY src) AS top FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INTEGER) DESC, score DESC, tgt) AS rn FROM near WHERE top - score <= 0.05)
SELECT src, tgt, round(score, 6) AS score FROM r WHERE rn = 1
""")
def close_rerank(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_totalprice").alias("top"))
    scored = orders.crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("tgt"), F.col("o_custkey").alias("src"), (F.col("o_totalprice") / F.col("top")).alias("score"), "o_orderpriority")
    return linkage.close_rerank(scored, F.left("o_orderpriority", F.lit(1)).cast("int")).select("src", "tgt", r6("score").alias("score"))


#: Registries made of the tables: customers against suppliers, codes and names by key.
CODE_SQL = """
s AS (SELECT c_custkey AS src, upper(substr(md5(CAST(c_custkey % 700 AS VARCHAR)), 1, 18)) AS code, c_mktsegment AS person, CAST(c_nationkey AS VARCHAR) AS phone FROM customer),
g AS (SELECT o_orderkey AS tgt, upper(substr(md5(CAST(o_orderkey % 900 AS VARCHAR)), 1, 18)) AS code, CASE WHEN o_orderstatus = 'F' THEN 'MACHINERY' ELSE 'BUILDING' END AS person, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)
"""


def registries(spark, sf_dir):
    def code(c, n):
        return F.lower(F.concat(F.lit(" "), F.left(F.md5((F.col(c) % n).cast("string")), F.lit(9)), F.lit("-"), F.substring(F.md5((F.col(c) % n).cast("string")), 10, 9)))

    s = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), code("c_custkey", 700).alias("s_code"), F.col("c_name").alias("s_name"), F.col("c_mktsegment").alias("s_person"), F.lit("").alias("s_address"), F.lit("").alias("s_phone"))
    person = F.when(F.col("o_orderstatus") == "F", "MACHINERY").otherwise("BUILDING")
    g = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tgt"), code("o_orderkey", 900).alias("t_code"), F.lit("").alias("t_name"), person.alias("t_person"), F.lit("").alias("t_address"), F.lit("").alias("t_phone"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("t_date"))
    return s, g


RANK_SQL = f"""
WITH {CODE_SQL},
p AS (SELECT src, tgt, date, code, CASE WHEN lower(s.person) = lower(g.person) THEN 40 WHEN jaccard(lower(s.person), lower(g.person)) > 0.8 THEN 20 ELSE 0 END + 10 * 2 / 5.0 + least(5.0, len(CAST(tgt AS VARCHAR)) / 5) AS sel FROM s JOIN g USING (code))
"""


@query(RANK_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sel DESC, tgt) AS rn, count(*) OVER (PARTITION BY src) AS duplicate_count FROM p)
SELECT src, tgt, code AS match_key, round(sel, 6) AS selection_score, duplicate_count FROM r WHERE rn = 1""")
def exact_join_rank(spark, sf_dir):
    s, g = registries(spark, sf_dir)
    return linkage.code_best(s, g).select("src", "tgt", "match_key", r6("selection_score").alias("selection_score"), "duplicate_count")


@query(RANK_SQL + """
SELECT src, tgt, CAST(row_number() OVER (PARTITION BY src ORDER BY date DESC, tgt) AS INTEGER) AS match_rank, row_number() OVER (PARTITION BY src ORDER BY sel DESC, tgt) = 1 AS is_primary,
       count(*) OVER (PARTITION BY src) AS total_matches, max(date) OVER (PARTITION BY src) AS latest, min(date) OVER (PARTITION BY src) AS earliest FROM p""")
def exact_join_all(spark, sf_dir):
    s, g = registries(spark, sf_dir)
    return linkage.code_matches(s, g).select("src", "tgt", "match_rank", "is_primary", "total_matches", "latest", "earliest")


@query("SELECT a.p_partkey AS src, min(b.p_partkey) AS tgt FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) GROUP BY 1")
def name_join(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    s = parts.select(F.col("p_partkey").alias("src"), F.concat(F.lit(" "), F.upper("p_name")).alias("s_name"))
    firsts = parts.groupBy(F.col("p_name").alias("t_name")).agg(F.min("p_partkey").alias("tgt"))
    return linkage.name_join(s, firsts).select("src", "tgt")


@query("SELECT c_custkey AS src FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_unmatched(spark, sf_dir):
    done = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"))
    return linkage.unmatched(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src")), done)


@query("""
WITH new AS (SELECT o_orderkey AS src, o_custkey AS tgt, o_totalprice AS score FROM orders),
old AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS tgt, o_totalprice + (o_orderkey % 2) - 0.5 AS score FROM orders WHERE o_orderstatus <> 'P')
SELECT new.src, CASE WHEN old.src IS NULL THEN 'matched' WHEN old.tgt = new.tgt AND new.score <= old.score THEN 'skipped' ELSE 'updated' END AS decision FROM new LEFT JOIN old ON old.src = new.src
""")
def incremental_decision(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    new = orders.select(key.alias("src"), cust.alias("tgt"), price.alias("score"))
    old = orders.filter("o_orderstatus <> 'P'").select(key.alias("src"), F.when(key % 3 == 0, cust + 1).otherwise(cust).alias("tgt"), (price + key % 2 - 0.5).alias("score"))
    return incremental.decisions(new, old, "src", "tgt", "score").select("src", "decision")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM r WHERE rn = 1
""")
def upsert_latest(spark, sf_dir):
    events = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    order = [F.desc("ts"), F.desc("event_id")]
    keys = ["user_id", "event_type"]
    old = incremental.latest(events.filter("event_id % 2 = 0"), keys, order)
    new = incremental.latest(events.filter("event_id % 2 = 1").unionByName(old), keys, order)
    return incremental.upsert(old, new, keys).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("""
SELECT o_orderkey AS src, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def detail_lookup(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("c_custkey"))
    out = orders.join(t(spark, sf_dir, "customer").filter("c_acctbal > 0"), "c_custkey", "left")
    out = out.join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("src", "c_name", "n_name", "r_name")


@query("SELECT c_custkey AS src, coalesce(CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment END, n_name) AS segment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def backfill_empty(spark, sf_dir):
    customers = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), "c_nationkey", F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")).otherwise(" ").alias("segment"))
    return incremental.backfilled(customers, t(spark, sf_dir, "nation"), ("c_nationkey", "n_nationkey"), ("segment", "n_name")).select("src", "segment")


@query("""
WITH c AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS n, c_mktsegment AS s, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS rep FROM customer),
e AS (SELECT id, rep, 'n' AS attr, n AS v, 0.7 AS w FROM c UNION ALL SELECT id, rep, 's', s, 0.3 FROM c),
g AS (SELECT attr, v, count(*) AS degree FROM e GROUP BY 1, 2),
p AS (SELECT a.id AS src, b.rep AS linked_class, b.id AS other, sum(a.w / (1 + ln(1 + degree))) AS weight, count(*) AS shared
      FROM e a JOIN e b ON a.attr = b.attr AND a.v = b.v AND a.id <> b.id JOIN g ON g.attr = a.attr AND g.v = a.v GROUP BY 1, 2, 3)
SELECT src, linked_class, max(shared) AS shared, count(*) AS linked, round(1 / (1 + exp(-max(weight))), 6) AS score FROM p GROUP BY 1, 2
""")
def shared_attr_score(spark, sf_dir):
    """Each customer's links by nation and segment: to which classes of customers, how many of them, with what score."""
    attributes, customers = {"c_nationkey": 0.7, "c_mktsegment": 0.3}, t(spark, sf_dir, "customer")
    found = linkage.shared_attributes(customers, "c_custkey", attributes)
    ways = found.select("a", "b", "shared", "score", F.col("members_b").alias("linked")).unionByName(found.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "score", F.col("members_a").alias("linked")))
    each = linkage.attribute_classes(customers, "c_custkey", attributes).join(ways, F.col("rep") == F.col("a"))
    others = F.when(F.col("rep") == F.col("b"), F.col("linked") - 1).otherwise(F.col("linked"))
    return each.select(F.col("id").alias("src"), F.col("b").alias("linked_class"), "shared", others.alias("linked"), r6("score").alias("score"))


@query()
def registry_linkage(spark, sf_dir):
    """All stages of linkage: codes, structured names, fast names; suppliers' names against customers'."""
    def named(table, key, name, x):
        rows = t(spark, sf_dir, table)
        return rows.select(F.col(key).alias({"s": "src", "t": "tgt"}[x]), F.col(name).alias(f"{x}_name"), F.lit("").alias(f"{x}_address"), F.lit("").alias(f"{x}_code"), F.lit("").alias(f"{x}_person"), F.lit("").alias(f"{x}_phone"), F.lit("").alias(f"{x}_date"))

    return linkage.registry_linkage(named("nation", "n_nationkey", "n_name", "s"), named("region", "r_regionkey", "r_name", "t").unionByName(named("nation", "n_nationkey", "n_name", "t").withColumn("tgt", F.col("tgt") + 100)))


#: Longest common subsequences (l) of all pairs of texts x, y that a table `need` asks for.
LCS_SQL = """
steps AS (SELECT x, y, 0 AS i, [0 FOR j IN range(0, len(y) + 1)] AS v FROM need
      UNION ALL
      SELECT x, y, i + 1, list_reduce(list_prepend([0], [[CASE WHEN y[j] = x[i + 1] THEN v[j] + 1 ELSE v[j + 1] END] FOR j IN range(1, len(y) + 1)]), lambda acc, c: list_append(acc, greatest(acc[len(acc)], c[1])))
      FROM steps WHERE i < len(x)),
lcs AS (SELECT x, y, 2 * v[len(y) + 1] / (len(x) + len(y)) AS r FROM steps WHERE i = len(x))"""


@query(f"""
WITH RECURSIVE n AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
s AS (SELECT p_name, k, {SLICES_SQL} AS g FROM n),
c AS (SELECT a.p_name AS src, b.p_name AS tgt, a.k AS x, b.k AS y FROM s a, s b WHERE len(list_intersect(a.g, b.g)) / len(a.g) >= 0.3 - 1e-9),
ends AS (SELECT DISTINCT x, y, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS short, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS long FROM c WHERE greatest(len(x), len(y)) / least(len(x), len(y)) >= 1.5),
windows AS (SELECT x, y, short, long[greatest(1, i + 1):i + len(short)] AS w FROM (SELECT *, unnest(range(1 - len(short), len(long))) AS i FROM ends)),
need AS (SELECT x, y FROM c UNION SELECT short, w FROM windows),
{LCS_SQL},
part_best AS (SELECT windows.x, windows.y, max(r) AS r FROM windows JOIN lcs ON lcs.x = short AND lcs.y = w GROUP BY 1, 2),
scored AS (SELECT src, tgt, CASE WHEN c.x = c.y THEN 1.0 ELSE 0.5 * lcs.r + 0.5 * greatest(lcs.r, 0.9 * coalesce(part_best.r, 0)) END AS score
           FROM c JOIN lcs ON lcs.x = c.x AND lcs.y = c.y LEFT JOIN part_best ON part_best.x = c.x AND part_best.y = c.y),
found AS (SELECT * FROM scored WHERE score >= 0.75 - 1e-12)
SELECT src, tgt, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY src ORDER BY tgt) AS INTEGER) AS match_rank, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) = 1 AS is_primary FROM found
""")
def fuzzy_linkage(spark, sf_dir):
    """Distinct part names among themselves by the blended name similarity; all matches, ranked."""
    names = part_names(spark, sf_dir)
    s = names.select(F.col("p_name").alias("src"), F.col("p_name").alias("s_name"), F.lit("").alias("s_address"), F.lit("").alias("s_person"))
    g = names.select(F.col("p_name").alias("tgt"), F.col("p_name").alias("t_name"), F.lit("").alias("t_address"), F.lit("").alias("t_person"), F.lit("").alias("t_date"), F.lit("").alias("t_code"), F.lit("").alias("t_phone"))
    return linkage.fuzzy_all(s, g, threshold=0.75).select("src", "tgt", r6("score").alias("score"), "match_rank", "is_primary")


@query(f"""
WITH RECURSIVE {PART_SLICES_SQL},
w AS (SELECT p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{{2,}}')) AS g, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sorted, regexp_replace(p_name, '[^a-zA-Z0-9_]', '', 'g') AS k FROM n),
t3 AS (SELECT p_name, g, sorted, list_distinct([k[i:i+2] for i in range(1, len(k) - 1)]) AS grams FROM w),
words AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / len(a.g) AS score FROM w a, w b WHERE len(a.g) > 0),
x AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM pairs WHERE score >= 0.3 - 1e-9),
y AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM words WHERE score >= 0.5 - 1e-9),
both_ AS (SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, x.score AS xs, y.score AS ys FROM (SELECT * FROM x WHERE rn <= 50) x FULL JOIN (SELECT * FROM y WHERE rn <= 50) y ON x.a = y.a AND x.b = y.b),
full_ AS (SELECT both_.*, p.sorted AS sa, q.sorted AS sb,
                coalesce(xs, CASE WHEN len(list_distinct(list_concat(p.grams, q.grams))) > 0 THEN len(list_intersect(p.grams, q.grams)) / len(list_distinct(list_concat(p.grams, q.grams))) ELSE 0 END) AS sl,
                coalesce(ys, CASE WHEN len(list_distinct(list_concat(p.g, q.g))) > 0 THEN len(list_intersect(p.g, q.g)) / len(list_distinct(list_concat(p.g, q.g))) ELSE 0 END) AS wo
          FROM both_ JOIN t3 p ON p.p_name = both_.a JOIN t3 q ON q.p_name = both_.b),
need AS (SELECT a AS x, b AS y FROM full_ UNION SELECT sa, sb FROM full_),
{LCS_SQL},
scored AS (SELECT a, b, 0.4 * p.r + 0.3 * q.r + 0.2 * sl + 0.1 * wo AS score FROM full_ JOIN lcs p ON p.x = a AND p.y = b JOIN lcs q ON q.x = sa AND q.y = sb),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS rank FROM scored WHERE score >= 0.75 - 1e-12)
SELECT a AS src, b AS tgt, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10
""")
def slice_matches(spark, sf_dir):
    names = part_names(spark, sf_dir)
    found = linkage.slice_matches(names.select(F.col("p_name").alias("src"), F.col("p_name").alias("s_name")), names.select(F.col("p_name").alias("tgt"), F.col("p_name").alias("t_name")))
    return found.select("src", "tgt", r6("score").alias("score"), "rank")


@query(f"""
WITH {PART_SLICES_SQL},
scored AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE (greatest(len(a), len(b)) - levenshtein(a, b)) / greatest(len(a), len(b)) END AS score FROM pairs WHERE score >= 0.3 - 1e-9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM scored WHERE score >= 0.7)
SELECT a AS src, b AS tgt, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'p_name->p_name' AS matched,
       CASE WHEN score >= 0.9 THEN 'very_high' WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS confidence, 'good_match' AS match_type FROM ranked WHERE rank <= 10
""")
def mapped_linkage(spark, sf_dir):
    """User-mapped linkage of the distinct part names by the fallback strategy."""
    from weftline.plans.mapping import Mapping, linked

    names = part_names(spark, sf_dir)
    found = linked(names, names, [Mapping("p_name", "p_name", kind="levenshtein", primary=True)], "p_name", "p_name")
    return found.select("src", "tgt", r6("score").alias("score"), "rank", F.array_join("matched_fields", ",").alias("matched"), "confidence", "match_type")


@query()
def mapping_suggestions(spark, sf_dir):
    from weftline.plans.mapping import suggestions

    found = suggestions(t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier"))
    return spark.createDataFrame(found, "source_field string, target_field string, score double, rank int")


def chinese_registry(spark, sf_dir):
    """Customers with an invented company name and address in Chinese, and another spelling of both."""
    k = F.col("c_custkey")

    def pick(words: str, n) -> F.Column:
        options = words.split()
        return F.element_at(F.array(*[F.lit(w) for w in options]), (n % len(options) + 1).cast("int"))

    district, road = pick("虹口 杨浦 静安 徐汇 长宁", F.col("c_nationkey")), pick("天宝 四平 南京 中山 延安", k % 7)
    core, business = pick("宏达 永兴 华美 金源 瑞丰 长江", k), pick("电子 机械 贸易 食品 物流", k % 11)
    number = (k % 900 + 1).cast("string")
    address = F.concat(F.lit("上海市"), district, F.lit("区"), road, F.lit("路"), number, F.lit("号"))
    other = F.concat(F.lit("上海市市辖区"), district, F.lit("区"), road, F.when(k % 3 == 0, "大道").otherwise("路"), F.when(k % 5 == 0, (k % 900 + 2).cast("string")).otherwise(number), F.when(k % 2 == 0, "#").otherwise("号"))
    name = F.concat(F.lit("上海"), core, business, F.lit("有限公司"))
    alias = F.concat(F.lit("上海市"), F.when(k % 4 == 0, pick("宏大 永新 华美 金源 瑞风 长江", k)).otherwise(core), business, F.when(k % 2 == 0, "股份有限公司").otherwise("有限公司"))
    return t(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), alias.alias("other_name"), address.alias("address"), other.alias("other_address"))


#: Both spellings of chinese_registry(), in SQL.
SPELLINGS_SQL = """
parts AS (SELECT c_custkey, c_custkey AS k, string_split('虹口 杨浦 静安 徐汇 长宁', ' ')[c_nationkey % 5 + 1] AS district, string_split('天宝 四平 南京 中山 延安', ' ')[c_custkey % 7 % 5 + 1] AS road,
                 string_split('宏达 永兴 华美 金源 瑞丰 长江', ' ')[c_custkey % 6 + 1] AS core, string_split('宏大 永新 华美 金源 瑞风 长江', ' ')[c_custkey % 6 + 1] AS slip, string_split('电子 机械 贸易 食品 物流', ' ')[c_custkey % 11 % 5 + 1] AS business FROM customer),
spellings AS (SELECT c_custkey, '上海' || core || business || '有限公司' AS name, '上海市' || CASE WHEN k % 4 = 0 THEN slip ELSE core END || business || CASE WHEN k % 2 = 0 THEN '股份有限公司' ELSE '有限公司' END AS other_name,
                     '上海市' || district || '区' || road || '路' || CAST(k % 900 + 1 AS VARCHAR) || '号' AS address,
                     '上海市市辖区' || district || '区' || road || CASE WHEN k % 3 = 0 THEN '大道' ELSE '路' END || CAST(CASE WHEN k % 5 = 0 THEN k % 900 + 2 ELSE k % 900 + 1 END AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '#' ELSE '号' END AS other_address FROM parts)"""


@query(f"""
WITH {SPELLINGS_SQL}
SELECT c_custkey, regexp_extract(address, '^(..市)', 1) AS province, '' AS city, regexp_extract(address, '市(..区)', 1) AS district, '' AS town, regexp_extract(address, '区(..路)', 1) AS street, regexp_extract(address, '[0-9]+号') AS number, '' AS building, '' AS detail,
       CASE WHEN replace(replace(replace(other_address, '市辖区', ''), '大道', '路'), '#', '号') = address THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM spellings
""")
def address_levels(spark, sf_dir):
    """Parts of each address, and its similarity by levels with another spelling."""
    from weftline.functions.address import address_parts, address_similarity

    rows = chinese_registry(spark, sf_dir)
    return rows.select("c_custkey", address_parts(F.col("address")).alias("p"), r6(address_similarity(F.col("address"), F.col("other_address"))).alias("score")).select("c_custkey", "p.*", "score")


@query()
def company_names(spark, sf_dir):
    """Structured, intelligent and blended similarity of each name with another spelling."""
    from weftline.functions.fuzzy import name_similarity
    from weftline.functions.names import intelligent_udf, structured_similarity

    a, b = F.col("name"), F.col("other_name")
    rows = chinese_registry(spark, sf_dir).select("c_custkey", structured_similarity(a, b, F.col("address"), F.col("other_address")).alias("s"), r6(intelligent_udf(a, b)).alias("intelligent"), r6(name_similarity(a, b)).alias("blend"))
    return rows.select("c_custkey", r6("s.overall").alias("overall"), r6("s.core").alias("core"), "s.conflict", "s.matched", "intelligent", "blend")


@query()
def name_conflicts(spark, sf_dir):
    """Conflict, seven-part blend and record blend of each name with another spelling; coarse address similarity."""
    from weftline.functions.address import coarse_udf, precise_udf
    from weftline.functions.conflicts import blended_udf, conflict_udf, record_blend

    a, b, x, y = (F.col(c) for c in ("name", "other_name", "address", "other_address"))
    rows = chinese_registry(spark, sf_dir)
    return rows.select("c_custkey", conflict_udf(a, b).alias("conflict"), r6(blended_udf(a, b)).alias("blend"), r6(record_blend(a, b, x, y)).alias("record"), r6(coarse_udf(x, y)).alias("coarse"), (precise_udf(x, y) == 1).alias("precise"))


@query(f"""
WITH {SPELLINGS_SQL},
f AS (SELECT 'name' AS field_name, unnest(list_filter(list_distinct([x[i:i+1] for i in range(1, len(x))]), lambda w: w NOT IN ('有限', '公司', '企业', '集团', '工厂', '商店', '中心', '责任', '股份'))) AS keyword FROM (SELECT regexp_replace(name, '有限公司$', '') AS x FROM spellings)
      UNION ALL SELECT 'address', unnest([address[1:3], address[1:6], regexp_extract(address, '区(..路)', 1), regexp_extract(address, '[0-9]+号')]) FROM spellings)
SELECT field_name, keyword, count(*) AS n FROM f GROUP BY 1, 2
""")
def field_keywords(spark, sf_dir):
    """Keyword index of names and addresses: keyword, in how many records."""
    rows = chinese_registry(spark, sf_dir)
    return blocking.keyword_index(rows, "c_custkey", {"name": "unit_name", "address": "address"}, "customer").groupBy("field_name", "keyword").agg(F.count("*").alias("n"))


@query(f"""
WITH RECURSIVE {SPELLINGS_SQL},
c AS (SELECT DISTINCT name AS x, other_name AS y FROM spellings),
windows AS (SELECT x, y, y[greatest(1, i + 1):i + len(x)] AS w FROM (SELECT *, unnest(range(1 - len(x), len(y))) AS i FROM c)),
need AS (SELECT x, y FROM c UNION SELECT x, w FROM windows),
{LCS_SQL},
part_best AS (SELECT windows.x, windows.y, max(r) AS r FROM windows JOIN lcs ON lcs.x = windows.x AND lcs.y = w GROUP BY 1, 2),
four AS (SELECT c.x, c.y, lcs.r AS fuzzy, CASE WHEN c.x = c.y THEN 1.0 ELSE lcs.r END AS words, 0.8 * lcs.r + 0.2 * part_best.r AS slices, len(list_intersect(string_split(c.x, ''), string_split(c.y, ''))) / len(list_distinct(list_concat(string_split(c.x, ''), string_split(c.y, '')))) AS chars FROM c JOIN lcs ON lcs.x = c.x AND lcs.y = c.y JOIN part_best ON part_best.x = c.x AND part_best.y = c.y),
m AS (SELECT *, (0.48 * chars + 0.24 * words + 0.2 * slices + 0.1 * fuzzy) / 1.02 AS score, (chars + words + slices + fuzzy) / 4 AS mean FROM four),
v AS (SELECT *, ((chars - mean) ** 2 + (words - mean) ** 2 + (slices - mean) ** 2 + (fuzzy - mean) ** 2) / 4 AS variance FROM m)
SELECT c_custkey, round(score, 6) AS score, round(least(1.0, mean * greatest(0.0, 1 - variance) + 0.1), 6) AS confidence, CAST(0.8 AS DOUBLE) AS threshold, score >= 0.8 AS matched FROM spellings JOIN v ON name = x AND other_name = y
""")
def hybrid_scores(spark, sf_dir):
    """Ensemble of four name similarities in balanced mode."""
    from weftline.functions import fuzzy

    rows = chinese_registry(spark, sf_dir)
    a, b = F.col("name"), F.col("other_name")
    scored = rows.select("c_custkey", fuzzy.ratio_udf(a, b).alias("fuzzy"), fuzzy.token_set_udf(a, b).alias("optimized_fuzzy"), fuzzy.slice_blend_udf(a, b).alias("enhanced"), S.char_jaccard(a, b).alias("intelligent"), scoring.data_quality(F.lit(0.9), a).alias("quality"))
    found = scoring.hybrid({k: F.col(k) for k in ("fuzzy", "optimized_fuzzy", "enhanced", "intelligent")}, "balanced", F.col("quality"))
    return scored.select("c_custkey", found.alias("h")).select("c_custkey", r6("h.score").alias("score"), r6("h.confidence").alias("confidence"), "h.threshold", "h.matched")


# --- statistics ---------------------------------------------------------------------------------------------


@query("SELECT CAST(o_custkey AS VARCHAR) AS association_id, count(*) AS members, round(max(o_totalprice), 6) AS confidence, round(avg((CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 2.0 END) / 2), 6) AS quality FROM orders GROUP BY 1 HAVING count(*) > 1")
def assoc_by_customer(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    found = stats.associations(orders, "o_custkey", F.col("o_totalprice"), ["status", "o_orderpriority"])
    return found.select("association_id", "members", r6("confidence").alias("confidence"), r6("quality").alias("quality"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS association_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def assoc_records(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    groups = stats.associations(orders, "o_custkey", F.col("o_totalprice"), ["o_orderpriority"])
    return stats.association_records(orders, groups, "o_custkey").select("association_id", "o_orderkey")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS members, avg((CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 2.0 END) / 2) AS quality FROM orders GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS groups, count(*) FILTER (members > 0) AS with_records, round(100.0 * count(*) FILTER (members > 0) / count(*), 2) AS rate, round(avg(members), 6) AS avg_members, round(avg(quality), 6) AS avg_quality FROM g
""")
def assoc_stats(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    found = stats.association_stats(stats.associations(orders, "o_custkey", F.col("o_totalprice"), ["status", "o_orderpriority"]))
    return found.select("groups", "with_records", "rate", r6("avg_members").alias("avg_members"), r6("avg_quality").alias("avg_quality"))


@query("SELECT o_orderstatus AS kind, count(*) AS n, round(avg(o_totalprice), 4) AS avg_score FROM orders GROUP BY 1")
def stats_by_status(spark, sf_dir):
    return stats.by_type(t(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice").select(F.col("o_orderstatus").alias("kind"), "n", F.round("avg_score", 4).alias("avg_score"))


@query("""
WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1)
SELECT CASE WHEN k LIKE '1%' OR k LIKE '2%' THEN 'urgent' WHEN k LIKE '5%' THEN 'low' ELSE 'none' END AS kind, CAST(sum(n) AS BIGINT) AS n,
       CASE WHEN k LIKE '5%' THEN 1.0 ELSE round(sum(a * n) / sum(n), 4) END AS avg_score FROM g GROUP BY 1, k LIKE '5%'
""")
def stats_fold_prefix(spark, sf_dir):
    found = stats.folded(t(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", {"1": "urgent", "2": "urgent", "5": "low"}, {"low": 1.0})
    return found.select("kind", "n", F.round("avg_score", 4).alias("avg_score"))


@query("""
SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS total, count(*) FILTER (o_totalprice >= 200000) AS matched, round(100.0 * count(*) FILTER (o_totalprice >= 200000) / count(*), 2) AS rate FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(*) FILTER (o_totalprice >= 200000), round(100.0 * count(*) FILTER (o_totalprice >= 200000) / count(*), 2) FROM orders GROUP BY 2
""")
def match_rate_stats(spark, sf_dir):
    return stats.match_rates(t(spark, sf_dir, "orders"), F.col("o_totalprice") >= 200000, "o_orderstatus", "o_orderpriority")


@query("SELECT count(*) AS total, round(avg(l_quantity / 50), 6) AS avg_score, max(l_quantity / 50) AS max_score, min(l_quantity / 50) AS min_score, count(*) FILTER (l_quantity / 50 >= 0.8) AS high FROM lineitem")
def overall_scores(spark, sf_dir):
    found = stats.overall(t(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("score")), "score")
    return found.withColumn("avg_score", r6("avg_score"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, round(avg(l_discount), 6) AS avg_score FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2")
def pair_rollup(spark, sf_dir):
    found = stats.pair_rollup(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_discount", F.col("l_quantity") > 10)
    return found.select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), "n", r6("avg_score").alias("avg_score"))


@query("SELECT CASE WHEN l_quantity / 50 >= 0 AND l_quantity / 50 < 1 THEN CAST(floor(l_quantity / 50 * 10) AS BIGINT) ELSE -1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def score_histogram(spark, sf_dir):
    return stats.histogram(t(spark, sf_dir, "lineitem"), F.col("l_quantity") / 50)


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark, sf_dir):
    return stats.duplicates(t(spark, sf_dir, "part"), "p_name")


@query("SELECT count(*) AS duplicate_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1)")
def dup_total(spark, sf_dir):
    return stats.duplicate_total(t(spark, sf_dir, "part"), "p_name")


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_value_counts(spark, sf_dir):
    """A top-ten report."""
    return stats.value_counts(t(spark, sf_dir, "part"), "p_name", 10)


@query("""
WITH v AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT col, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM c)
SELECT col AS "column", value, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def top_values(spark, sf_dir):
    return profile.top_values(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_sorted(spark, sf_dir):
    """The third page of fifty."""
    return stats.page(t(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 50).select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM orders")
def page_info(spark, sf_dir):
    return stats.page_info(t(spark, sf_dir, "orders"), 50)


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, sf_dir):
    return stats.best_per_group(t(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)EXAMPLE[.](com|org)') OR regexp_matches(html, '(?i)<h1>')")
def regex_search(spark, sf_dir):
    return stats.search(t(spark, sf_dir, "pages"), "EXAMPLE[.](com|org)", "url").select("page_id").union(stats.search(t(spark, sf_dir, "pages"), "<h1>", "html").select("page_id")).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000")
def prefix_filter(spark, sf_dir):
    return stats.having_prefix(t(spark, sf_dir, "orders"), "o_orderpriority", "1").filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") >= 1000)).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') OR contains(text, 'der')")
def containing_any(spark, sf_dir):
    return stats.containing_any(t(spark, sf_dir, "documents"), "text", ["the", "der"]).select("doc_id")


@query("""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS g FROM documents)
SELECT doc_id, CAST(len(list_intersect(g, ['the', 'and', 'nation', 'de'])) AS BIGINT) AS score FROM w WHERE len(list_intersect(g, ['the', 'and', 'nation', 'de'])) > 0
""")
def text_search(spark, sf_dir):
    return stats.text_search(t(spark, sf_dir, "documents"), "doc_id", "text", "the and nation de")


@query("SELECT o_orderkey AS src, CASE WHEN o_orderkey % 5 = 0 THEN 'confirmed' WHEN o_orderstatus = 'P' THEN 'pending' END AS review_status FROM orders")
def reviewed(spark, sf_dir):
    orders = t(spark, sf_dir, "orders")
    results = orders.select(F.col("o_orderkey").alias("src"), F.when(F.col("o_orderstatus") == "P", "pending").alias("review_status"), F.lit(None).cast("string").alias("review_notes"))
    decisions = orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("src"), F.lit("confirmed").alias("review_status"), F.lit("seen").alias("review_notes"))
    return stats.reviewed(results, decisions).select("src", "review_status")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '2%' AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def pending_review(spark, sf_dir):
    """A list of the newest hundred."""
    orders = t(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.when(F.col("o_orderpriority").startswith("2"), "fuzzy_enhanced").otherwise("exact").alias("match_type"), F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "pending").alias("review_status"), F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k")).alias("newest"))
    return stats.pending_review(rows, "newest").select("o_orderkey")


@query("""
WITH n AS (SELECT count(*) FILTER (l_quantity > 25 AND l_discount > 0.05) AS tp, count(*) FILTER (l_quantity <= 25 AND l_discount > 0.05) AS fp, count(*) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS fn FROM lineitem),
p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM n)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p
""")
def precision_recall(spark, sf_dir):
    out = stats.precision_recall(t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 25, F.col("l_discount") > 0.05)
    return out.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("""
WITH s AS (SELECT unnest(list_distinct([right(p_name, 2), right(p_name, 3)])) AS suffix FROM part WHERE len(p_name) >= 2)
SELECT suffix, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, suffix LIMIT 10
""")
def name_suffixes(spark, sf_dir):
    """A top-ten report."""
    return stats.suffixes(t(spark, sf_dir, "part"), "p_name")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS items")
def dashboard_totals(spark, sf_dir):
    return stats.dashboard({"customers": t(spark, sf_dir, "customer"), "orders": t(spark, sf_dir, "orders"), "items": t(spark, sf_dir, "lineitem")})


@query("SELECT count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def trailing_average(spark, sf_dir):
    return stats.trailing_average(t(spark, sf_dir, "events"), "ts", "value", 3600).withColumn("avg_value", r6("avg_value"))


@query("""
WITH g AS (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1), s AS (SELECT c_custkey, coalesce(m, 0) AS m FROM customer LEFT JOIN g ON c_custkey = o_custkey)
SELECT count(*) AS sources, count(*) FILTER (m > 0) AS matched, count(*) FILTER (m > 1) AS several, CAST(sum(m) AS BIGINT) AS records, round(avg(m), 6) AS avg_matches, round(100.0 * count(*) FILTER (m > 0) / greatest(count(*), 1), 6) AS match_rate FROM s
""")
def multi_match_stats(spark, sf_dir):
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("m"))
    summary = t(spark, sf_dir, "customer").join(n, "c_custkey", "left").select(F.coalesce("m", F.lit(0)).alias("total_matches"))
    out = stats.multi_match_stats(summary)
    return out.withColumn("avg_matches", r6("avg_matches")).withColumn("match_rate", r6("match_rate"))


# --- scalar functions ---------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS b FROM lineitem),
d AS (SELECT *, CASE WHEN a = 0 AND coalesce(b, 0) = 0 THEN 0.0 WHEN a = 0 OR coalesce(b, 0) = 0 THEN 1.0 ELSE abs(a - b) / greatest(abs(a), abs(b)) END AS d FROM p)
SELECT l_orderkey, l_linenumber, round(a, 2) AS a, round(CASE WHEN d <= 0.1 THEN 1 - d / 0.1 * 0.2 ELSE greatest(0.0, 1 - d) END, 6) AS score FROM d
""")
def numeric_tolerance(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    rows = t(spark, sf_dir, "lineitem").withColumn("b", F.lead("l_extendedprice").over(w))
    return rows.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("a"), r6(S.numeric(F.col("l_extendedprice"), F.col("b"))).alias("score"))


@query(r"""
WITH p AS (SELECT c_custkey, '+86-138' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS a, CASE c_custkey % 4 WHEN 0 THEN '0138' WHEN 1 THEN '86139' WHEN 2 THEN '021 ' ELSE '' END || lpad(CAST((c_custkey * 7919 + CASE WHEN c_custkey % 5 = 0 THEN 10000000 ELSE 0 END) % 100000000 AS VARCHAR), 8, '0') AS b FROM customer),
n AS (SELECT *, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db FROM p),
i AS (SELECT *, CASE WHEN substr(regexp_replace(a, '[^0-9+]', '', 'g'), 1, 3) = '+86' THEN substr(da, 3) ELSE da END AS ia, CASE WHEN substr(db, 1, 2) = '86' AND len(db) > 11 THEN substr(db, 3) ELSE db END AS ib FROM n)
SELECT c_custkey, regexp_replace(db, '^(0|86)', '') AS plain, ib AS international,
       CASE WHEN ia = ib THEN 1.0 WHEN len(ia) >= 8 AND len(ib) >= 8 AND right(ia, 8) = right(ib, 8) THEN 0.8 WHEN len(ia) >= 7 AND len(ib) >= 7 AND right(ia, 7) = right(ib, 7) THEN 0.7 ELSE 0.0 END AS score,
       (len(regexp_replace(db, '^(0|86)', '')) BETWEEN 7 AND 8) OR (len(regexp_replace(db, '^(0|86)', '')) BETWEEN 10 AND 12) AS valid FROM i
""")
def phone_rules(spark, sf_dir):
    k = F.col("c_custkey")
    a = F.concat(F.lit("+86-138"), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"))
    front = F.when(k % 4 == 0, "0138").when(k % 4 == 1, "86139").when(k % 4 == 2, "021 ").otherwise("")
    b = F.concat(front, F.lpad(((k * 7919 + F.when(k % 5 == 0, 10000000).otherwise(0)) % 100000000).cast("string"), 8, "0"))
    rows = t(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), b.alias("b"))
    return rows.select("c_custkey", N.phone(F.col("b")).alias("plain"), N.phone_international(F.col("b")).alias("international"), S.phone_suffix(F.col("a"), F.col("b")).alias("score"), T.valid_phone(F.col("b")).alias("valid"))


@query("SELECT o_orderkey, left(md5(o_orderkey || '_' || o_custkey || '_20240101'), 16) AS match_id FROM orders")
def match_id_md5(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", T.match_id(F.col("o_orderkey"), F.col("o_custkey"), "20240101").alias("match_id"))


@query("SELECT p_partkey, lower(regexp_replace(trim(p_name || '  (' || p_brand || ') '), '\\s+', ' ', 'g')) AS exact_name, replace(lower(p_name), ' ', '') AS spaceless, CASE WHEN len(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS shortened FROM part")
def name_normalisers(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("  （"), F.col("p_brand"), F.lit("] "))
    return t(spark, sf_dir, "part").select("p_partkey", N.exact_name(name).alias("exact_name"), N.spaceless(F.col("p_name")).alias("spaceless"), N.shortened(F.col("p_name"), 8).alias("shortened"))


@query("SELECT o_orderkey, o_orderpriority AS \"Priority\", round(o_totalprice / 1000, 0) AS \"Price\", '=\"' || o_orderkey || '\"' AS \"Id\" FROM orders")
def export_projection(spark, sf_dir):
    from weftline.sources.writers import export_rows

    rows = t(spark, sf_dir, "orders").withColumn("price", F.round(F.col("o_totalprice") / 1000, 0)).withColumn("none", F.lit("-"))
    return export_rows(rows, {"o_orderkey": "o_orderkey", "Priority": ["none", "o_orderpriority"], "Price": "price", "Id": "o_orderkey"}, texts=["Id"])


# --- profiles -----------------------------------------------------------------------------------------------

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_sql(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query(union_sql("SELECT '{c}' AS column, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, round((count(*) - count({c})) / count(*), 6) AS null_share, round(count(DISTINCT {c}) / count(*), 6) AS unique_share FROM orders", ORDER_COLUMNS))
def profile_columns(spark, sf_dir):
    out = profile.counts(t(spark, sf_dir, "orders"), ORDER_COLUMNS)
    return out.select("column", "rows", "nulls", "distinct_values", r6("null_share").alias("null_share"), r6("unique_share").alias("unique_share"))


@query(union_sql("SELECT '{c}' AS column, round(min({c}), 6) AS min_value, round(max({c}), 6) AS max_value, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives FROM lineitem", LINE_NUMBERS))
def profile_numbers(spark, sf_dir):
    out = profile.numeric_summary(t(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return out.select("column", *[r6(c).alias(c) for c in ("min_value", "max_value")], F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), *[r6(c).alias(c) for c in ("q1", "median", "q3")], "zeros", "negatives")


@query(union_sql("SELECT '{c}' AS column, CAST(min(len({c})) AS BIGINT) AS min_length, CAST(max(len({c})) AS BIGINT) AS max_length, round(avg(len({c})), 6) AS avg_length, count(*) FILTER ({c} = '') AS empty, count(*) FILTER (regexp_matches({c}, '[a-zA-Z]')) AS latin, count(*) FILTER (regexp_matches({c}, '[0-9]')) AS digits FROM documents", ["text", "lang", "source"]))
def profile_texts(spark, sf_dir):
    return profile.text_summary(t(spark, sf_dir, "documents"), ["text", "lang", "source"]).drop("cjk").withColumn("avg_length", r6("avg_length"))


@query("WITH g AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(2 AS BIGINT) AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS empty_rows FROM g")
def table_basics(spark, sf_dir):
    return profile.basics(t(spark, sf_dir, "part").select("p_name", "p_brand"))


@query(" UNION ALL ".join(f"(SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS frequency FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)" for c in ("p_name", "p_brand", "p_size")))
def column_modes(spark, sf_dir):
    return profile.modes(t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_size"])


@query(union_sql("SELECT '{c}' AS column, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS rows FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)", LINE_NUMBERS))
def iqr_outliers(spark, sf_dir):
    return profile.outliers(t(spark, sf_dir, "lineitem"), LINE_NUMBERS)


@query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]))
def pearson_pairs(spark, sf_dir):
    return profile.correlations(t(spark, sf_dir, "lineitem"), LINE_NUMBERS).withColumn("r", r6("r"))


FD_COLUMNS = ["c_nationkey", "c_mktsegment", "c_custkey"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS determinant, '{b}' AS dependent, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS strength FROM (SELECT {a}, count(DISTINCT {b}) AS n FROM customer WHERE {a} IS NOT NULL GROUP BY 1)" for a in FD_COLUMNS for b in FD_COLUMNS if a != b))
def fd_strength(spark, sf_dir):
    return profile.dependencies(t(spark, sf_dir, "customer"), FD_COLUMNS, -1.0).withColumn("strength", r6("strength"))


@query("SELECT CAST(count(*) * 5 AS BIGINT) AS cells, CAST(count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(CASE WHEN c_mktsegment <> 'FURNITURE' THEN 1 END) AS BIGINT) AS non_null, round((count(*) * 4 + count(CASE WHEN c_mktsegment <> 'FURNITURE' THEN 1 END)) / (count(*) * 5), 6) AS completeness, round(least(1.2 * (count(*) * 4 + count(CASE WHEN c_mktsegment <> 'FURNITURE' THEN 1 END)) / (count(*) * 5), 1.0), 6) AS score FROM customer")
def completeness_quality(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_mktsegment")))
    out = profile.completeness(rows)
    return out.withColumn("completeness", r6("completeness")).withColumn("score", r6("score"))


@query("""
WITH g AS (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2), d AS (SELECT sum(n) AS rows, sum(n - 1) AS duplicates FROM g)
SELECT CAST(rows AS BIGINT) AS rows, CAST(duplicates AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS type_issues, round(greatest(0.0, 1 - least(2 * duplicates / rows, 0.5)), 6) AS score FROM d
""")
def consistency_quality(spark, sf_dir):
    return profile.consistency(t(spark, sf_dir, "part").select("p_name", "p_brand")).withColumn("score", r6("score"))


@query(union_sql("SELECT '{c}' AS column, count(*) AS rows, count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS filled, count(DISTINCT {c}) AS unique_values, round(100.0 * count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') / count(*)) AS filled_rate, least(100.0, round(round(100.0 * count(*) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') / count(*)) * CASE WHEN count(DISTINCT {c}) / count(*) < 0.01 THEN 0.7 WHEN count(DISTINCT {c}) / count(*) <= 0.8 THEN 1.1 ELSE 1.0 END)) AS quality FROM orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))
def field_quality(spark, sf_dir):
    return profile.field_quality(t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
WITH c AS (SELECT count(*) AS rows, count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS there,
                  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS again,
                  CAST(count(*) FILTER (o_orderstatus IS NOT NULL AND TRY_CAST(o_orderstatus AS DOUBLE) IS NULL) = 0 AS INTEGER) + CAST(count(*) FILTER (o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS DOUBLE) IS NULL) = 0 AS INTEGER) AS texts,
                  count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01' OR o_orderdate < TIMESTAMP '1900-01-01') AS wrong FROM orders),
s AS (SELECT least(1.2 * there / (rows * 6), 1.0) AS completeness, greatest(0.0, 1 - least(2 * again / rows, 0.5) - least(0.1 * texts, 0.3)) AS consistency, greatest(0.0, 1 - 2 * wrong / there) AS validity, there / (rows * 6) AS share FROM c)
SELECT round(CAST(completeness AS DOUBLE), 6) AS completeness, round(CAST(consistency AS DOUBLE), 6) AS consistency, round(CAST(validity AS DOUBLE), 6) AS validity, round(CAST((completeness + consistency + validity) / 3 AS DOUBLE), 6) AS overall, completeness >= 0.6 AS valid FROM s
""")
def validation_overall(spark, sf_dir):
    """Judged as of the first day of 1998, so that some dates lie in the future."""
    found = profile.validation(t(spark, sf_dir, "orders"), F.to_timestamp(F.lit("1998-01-01")))
    return found.select(*[r6(c).alias(c) for c in ("completeness", "consistency", "validity", "overall")], "valid")


@query("""
SELECT 'url' AS column, 0.0 AS phone, 0.0 AS email, 'text' AS field_type UNION ALL SELECT 'html', 0.0, 0.0, 'text'
""")
def regex_field_types(spark, sf_dir):
    return profile.field_types(t(spark, sf_dir, "pages").select("url", "html")).select("column", "phone", "email", "field_type")


VALUE_TYPE_SQL = """
SELECT '{c}' AS column, round(count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NOT NULL) / count(*), 6) AS number, round(count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) / count(*), 6) AS date,
       round(count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL AND lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n')) / count(*), 6) AS boolean, count(*) AS n FROM (SELECT trim(CAST({c} AS VARCHAR)) AS v FROM orders) WHERE v <> ''"""


@query("SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN number > 0.8 THEN 'number' WHEN date > 0.8 THEN 'date' WHEN boolean > 0.8 THEN 'boolean' ELSE 'string' END AS data_type FROM (" + union_sql(VALUE_TYPE_SQL, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + ")")
def value_types(spark, sf_dir):
    found = profile.value_types(t(spark, sf_dir, "orders"))
    return found.select("column", *[r6(c).alias(c) for c in ("number", "date", "boolean")], "n", "data_type")


def share_sql(table: str, column: str, looks: dict[str, str]) -> str:
    """Shares of a column's values that match patterns, in SQL."""
    found = ", ".join(f"coalesce(round(count(*) FILTER (regexp_matches(v, '{p}')) / nullif(count(*), 0), 6), 0.0) AS {k}" for k, p in looks.items())
    return f"SELECT '{column}' AS column, {found}, coalesce(avg(len(v)), 0) AS length, count(*) FILTER (TRY_CAST(v AS TIMESTAMP) IS NOT NULL) / nullif(count(*), 0) AS date FROM (SELECT CAST({column} AS VARCHAR) AS v FROM {table}) WHERE v <> ''"


#: A registry in Chinese of the customers, in SQL: what chinese_registry() makes.
REGISTRY_SQL = """
registry AS (SELECT c_custkey, '上海' || core || business || '有限公司' AS name, '上海市' || district || '区' || road || '路' || CAST(number AS VARCHAR) || '号' AS address, core || '先生' AS person, '1380000' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS contact FROM (
  SELECT c_custkey, string_split('宏达 永兴 华美 金源 瑞丰 长江', ' ')[c_custkey % 6 + 1] AS core, string_split('电子 机械 贸易 食品 物流', ' ')[c_custkey % 11 % 5 + 1] AS business,
         string_split('虹口 杨浦 静安 徐汇 长宁', ' ')[c_nationkey % 5 + 1] AS district, string_split('天宝 四平 南京 中山 延安', ' ')[c_custkey % 7 % 5 + 1] AS road, c_custkey % 900 + 1 AS number FROM customer))"""


def registry_columns(spark, sf_dir) -> DataFrame:
    """The registry with a person and a phone number."""
    k = F.col("c_custkey")
    person = F.concat(F.element_at(F.array(*[F.lit(w) for w in "宏达 永兴 华美 金源 瑞丰 长江".split()]), (k % 6 + 1).cast("int")), F.lit("先生"))
    return chinese_registry(spark, sf_dir).select("c_custkey", "name", "address", person.alias("person"), F.concat(F.lit("1380000"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("contact"))


SEMANTIC = {"phone": profile.PHONE.replace("\\", "\\"), "email": T.EMAIL, "id_card": profile.ID_NUMBER, "credit_code": T.CREDIT_CODE}
ROLES = {"organisation": f"({profile.ORGANISATION_WORDS})", "person": "^[一-鿿]{2,4}$|^[A-Za-z ]+ [A-Za-z ]+$", "place": f"({profile.PLACE_HINTS})", "identifier": f"{T.CREDIT_CODE}|{profile.ID_NUMBER}|{profile.PHONE}"}


@query(f"""
WITH {REGISTRY_SQL}, f AS ({" UNION ALL ".join(share_sql("registry", c, SEMANTIC) for c in ("person", "contact"))} UNION ALL {share_sql("orders", "o_orderpriority", SEMANTIC)})
SELECT "column", CASE WHEN phone > 0.8 THEN 'phone' WHEN email > 0.8 THEN 'email' WHEN id_card > 0.8 THEN 'id_card' WHEN credit_code > 0.8 THEN 'credit_code' WHEN date > 0.8 THEN 'date' WHEN length > 50 THEN 'long_text' ELSE 'text' END AS semantic_type FROM f
UNION ALL SELECT 'c_custkey', 'integer' UNION ALL SELECT 'name', 'name' UNION ALL SELECT 'address', 'address'
""")
def semantic_types(spark, sf_dir):
    """By name and storage where they tell, else by the values."""
    registry = profile.semantic_types(registry_columns(spark, sf_dir))
    return registry.unionByName(profile.semantic_types(t(spark, sf_dir, "orders"), ["o_orderpriority"]))


@query(f"""
WITH {REGISTRY_SQL}, f AS ({" UNION ALL ".join(share_sql("registry", c, ROLES) for c in ("name", "address", "person", "contact"))})
SELECT "column", organisation, person, place, identifier, array_to_string(list_filter([CASE WHEN organisation > 0.3 THEN 'organisation' END, CASE WHEN person > 0.5 THEN 'person' END, CASE WHEN place > 0.3 THEN 'place' END, CASE WHEN identifier > 0.8 THEN 'identifier' END], lambda x: x IS NOT NULL), ',') AS roles FROM f
""")
def field_roles(spark, sf_dir):
    found = profile.field_roles(registry_columns(spark, sf_dir), ["name", "address", "person", "contact"])
    return found.select("column", *[r6(c).alias(c) for c in ROLES], F.array_join("roles", ",").alias("roles"))


def content_sql(column: str) -> str:
    """Mean company and address score of a column of the registry, in SQL."""
    def hits(p: str) -> str:
        return f"len(regexp_extract_all(v, '{p}'))"

    company = f"CASE WHEN regexp_matches(v, '({profile.COMPANY_TAILS})$') THEN 0.8 ELSE 0.0 END + least(0.4, 0.1 * {hits(profile.ORGANISATION_WORDS)}) - CASE WHEN {hits(profile.PLACE_HINTS)} > 2 THEN 0.3 ELSE 0.0 END + CASE WHEN len(v) BETWEEN 4 AND 50 THEN 0.2 WHEN len(v) > 50 THEN -0.2 ELSE 0.0 END - CASE WHEN regexp_matches(v, '[0-9]{{2,}}') THEN 0.1 ELSE 0.0 END"
    place = f"least(0.8, 0.15 * {hits(profile.PLACE_HINTS)}) + CASE WHEN regexp_matches(v, '[0-9]+号') THEN 0.3 ELSE 0.0 END + CASE WHEN regexp_matches(v, '[0-9]+[楼层]') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(v, '[0-9]+室') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(v, '[^市]+市.*[区县]') THEN 0.4 WHEN regexp_matches(v, '[省市区县]') THEN 0.2 ELSE 0.0 END - CASE WHEN regexp_matches(v, '({profile.COMPANY_TAILS})') THEN 0.4 ELSE 0.0 END + CASE WHEN len(v) BETWEEN 8 AND 100 THEN 0.1 WHEN len(v) < 8 THEN -0.2 ELSE 0.0 END"
    return f"SELECT '{column}' AS column, round(CAST(avg(CASE WHEN len(v) >= 2 THEN greatest(0.0, least(1.0, {company})) ELSE 0.0 END) AS DOUBLE), 6) AS company, round(CAST(avg(CASE WHEN len(v) >= 3 THEN greatest(0.0, least(1.0, {place})) ELSE 0.0 END) AS DOUBLE), 6) AS address FROM (SELECT trim({column}) AS v FROM registry) WHERE len(v) >= 1"


@query(f"WITH {REGISTRY_SQL}, f AS ({' UNION ALL '.join(map(content_sql, ('name', 'address', 'person')))}) SELECT *, CASE WHEN company > address AND company > 0.3 THEN 'company_name' WHEN address > company AND address > 0.3 THEN 'address' ELSE 'unknown' END AS content FROM f")
def content_scores(spark, sf_dir):
    found = profile.content_scores(registry_columns(spark, sf_dir), ["name", "address", "person"])
    return found.select("column", r6("company").alias("company"), r6("address").alias("address"), "content")


# --- graphs -------------------------------------------------------------------------------------------------

KG_SQL = """
e AS (
  SELECT 'c' || c_custkey AS id, 'ORGANIZATION' AS type, c_name AS label, 0.6 + c_custkey % 4 / 10.0 AS confidence FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'LOCATION', n_name, 0.9 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'LOCATION', r_name, 0.9 FROM region),
tr AS (
  SELECT 'c' || c_custkey AS s, 'LOCATED_IN' AS p, 'n' || c_nationkey AS o, 0.8 AS c FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'LOCATED_IN', 'r' || n_regionkey, 0.9 FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'REPRESENTS', 'c' || (s_suppkey * 3), 0.85 FROM supplier)
"""


def toy_graph(spark, sf_dir):
    """Customers in nations in regions, suppliers for customers."""
    c, n, r, s = (t(spark, sf_dir, x) for x in ("customer", "nation", "region", "supplier"))

    def ident(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))

    entities = c.select(ident("c", "c_custkey").alias("id"), F.lit(graph.ORGANISATION).alias("type"), F.col("c_name").alias("label"), (0.6 + F.col("c_custkey") % 4 / 10).alias("confidence"))
    entities = entities.unionByName(n.select(ident("n", "n_nationkey").alias("id"), F.lit(graph.LOCATION).alias("type"), F.col("n_name").alias("label"), F.lit(0.9).alias("confidence")))
    entities = entities.unionByName(r.select(ident("r", "r_regionkey").alias("id"), F.lit(graph.LOCATION).alias("type"), F.col("r_name").alias("label"), F.lit(0.9).alias("confidence")))
    entities = entities.withColumn("properties", F.create_map(F.lit("label"), F.col("label"))).withColumn("source_table", F.lit("toy"))

    def triple(df, sid, st, p, oid, ot, conf):
        return df.select(sid.alias("subject_id"), sid.alias("subject_label"), F.lit(st).alias("subject_type"), F.lit(p).alias("predicate"), oid.alias("object_id"), oid.alias("object_label"), F.lit(ot).alias("object_type"), F.lit(conf).alias("confidence"), F.lit("toy").alias("source"), F.array(F.lit("toy:1")).alias("evidence"))

    triples = triple(c, ident("c", "c_custkey"), graph.ORGANISATION, graph.LOCATED_IN, ident("n", "c_nationkey"), graph.LOCATION, 0.8)
    triples = triples.unionByName(triple(n, ident("n", "n_nationkey"), graph.LOCATION, graph.LOCATED_IN, ident("r", "n_regionkey"), graph.LOCATION, 0.9))
    triples = triples.unionByName(triple(s, ident("s", "s_suppkey"), graph.PERSON, graph.REPRESENTS, ident("c", F.col("s_suppkey") * 3), graph.ORGANISATION, 0.85))
    return entities, triples


@query("SELECT lower(substr(md5('ORGANIZATION:' || lower(c_name)), 1, 16)) AS id, 'ORGANIZATION' AS type, min(c_name) AS label, count(*) AS records FROM customer GROUP BY 1 UNION ALL SELECT substr(md5('ORGANIZATION:' || lower(s_name)), 1, 16), 'ORGANIZATION', min(s_name), count(*) FROM supplier GROUP BY 1")
def kg_entities(spark, sf_dir):
    a = graph.extracted(t(spark, sf_dir, "customer"), "c_custkey", {graph.ORGANISATION: ["c_name"]}, "customer")
    b = graph.extracted(t(spark, sf_dir, "supplier"), "s_suppkey", {graph.ORGANISATION: ["s_name"]}, "supplier")
    return graph.entity_summary(a.unionByName(b)).select("id", "type", "label", "records")


@query("""
SELECT substr(md5('ORGANIZATION:' || lower(c_name)), 1, 16) AS subject_id, 'LOCATED_IN' AS predicate, substr(md5('LOCATION:' || lower('市' || n_name)), 1, 16) AS object_id, 0.8 AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def kg_triples(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("place", F.concat(F.lit("市"), F.col("n_name")))
    entities = graph.extracted(rows, "c_custkey", {graph.ORGANISATION: ["c_name"], graph.LOCATION: ["place"]}, "customer")
    return graph.rule_triples(entities, graph.LOCATED_IN, "c_name", "place").select("subject_id", "predicate", "object_id", "confidence")


@query(f"WITH {KG_SQL} SELECT o AS subject_id, 'MANAGED_BY' AS predicate, s AS object_id, round(c * 0.9, 6) AS confidence FROM tr WHERE p = 'REPRESENTS'")
def kg_inverse(spark, sf_dir):
    return graph.inverse(toy_graph(spark, sf_dir)[1]).select("subject_id", "predicate", "object_id", r6("confidence").alias("confidence"))


@query(f"WITH {KG_SQL} SELECT a.s AS subject_id, a.p AS predicate, b.o AS object_id, round(least(a.c, b.c) * 0.8, 6) AS confidence FROM tr a JOIN tr b ON a.o = b.s AND a.p = b.p WHERE a.p = 'LOCATED_IN' AND a.s <> b.o")
def kg_transitive(spark, sf_dir):
    return graph.transitive(toy_graph(spark, sf_dir)[1]).select("subject_id", "predicate", "object_id", r6("confidence").alias("confidence"))


@query(f"WITH {KG_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM tr UNION ALL SELECT o FROM tr) GROUP BY 1) SELECT degree, count(*) AS nodes FROM d GROUP BY 1")
def kg_degree(spark, sf_dir):
    return graph.degree_distribution(toy_graph(spark, sf_dir)[1])


@query(f"WITH {KG_SQL} SELECT (SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM tr) AS edges, (SELECT count(*) FROM tr) / ((SELECT count(*) FROM e) * ((SELECT count(*) FROM e) - 1)) AS density")
def kg_density(spark, sf_dir):
    return graph.density(*toy_graph(spark, sf_dir))


@query(f"WITH {KG_SQL} SELECT type, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT p, count(*) FROM tr GROUP BY 1")
def kg_type_counts(spark, sf_dir):
    e, tr = toy_graph(spark, sf_dir)
    return graph.type_counts(e, "type").union(graph.type_counts(tr, "predicate"))


@query(f"WITH {KG_SQL} SELECT CASE WHEN c > 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM tr GROUP BY 1")
def kg_confidence_tiers(spark, sf_dir):
    return graph.confidence_tiers(toy_graph(spark, sf_dir)[1])


@query(f"""
WITH RECURSIVE {KG_SQL}, both_ways AS (SELECT s AS u, o AS v FROM tr WHERE p = 'LOCATED_IN' AND substr(s, 1, 1) = 'n' UNION SELECT o, s FROM tr WHERE p = 'LOCATED_IN' AND substr(s, 1, 1) = 'n'),
x(id, root) AS (SELECT id, id FROM e WHERE type = 'LOCATION' UNION SELECT both_ways.v, x.root FROM x JOIN both_ways ON both_ways.u = x.id)
SELECT id, min(root) AS component FROM x GROUP BY 1
""")
def kg_components(spark, sf_dir):
    e, tr = toy_graph(spark, sf_dir)
    return graph.components(e.filter("type = 'LOCATION'"), tr.filter("predicate = 'LOCATED_IN' and subject_id like 'n%'"))


@query(f"""
WITH {KG_SQL} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(avg(CASE WHEN confidence >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS high, 1.0 AS complete, round(count(DISTINCT type || ':' || lower(label)) / count(*), 6) AS unique_share,
round(0.4 * avg(confidence) + 0.3 * avg(CASE WHEN confidence >= 0.7 THEN 1.0 ELSE 0.0 END) + 0.2 + 0.1 * count(DISTINCT type || ':' || lower(label)) / count(*), 6) AS score FROM e
""")
def kg_entity_quality(spark, sf_dir):
    out = graph.entity_quality(toy_graph(spark, sf_dir)[0])
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "high", "complete", "unique_share", "score")])


@query(f"""
WITH {KG_SQL}, c AS (SELECT *, CASE WHEN p = 'REPRESENTS' OR substr(s, 1, 1) = 'c' THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN c >= 0.6 THEN 1.0 ELSE 0.0 END AS hi FROM tr)
SELECT count(*) AS n, round(avg(c), 6) AS mean, round(avg(ok), 6) AS consistent, 1.0 AS complete, round(avg(hi), 6) AS high, round(0.4 * avg(c) + 0.3 * avg(ok) + 0.2 + 0.1 * avg(hi), 6) AS score FROM c
""")
def kg_relation_quality(spark, sf_dir):
    out = graph.relation_quality(toy_graph(spark, sf_dir)[1])
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "consistent", "complete", "high", "score")])


@query(f"""
WITH {KG_SQL} SELECT count(*) AS n, round(avg(c), 6) AS mean, 1.0 AS complete, round((1.0 / 3 + 0.5) / 2, 6) AS evidence, 1.0 AS high, round(0.4 * avg(c) + 0.3 + 0.2 * (1.0 / 3 + 0.5) / 2 + 0.1, 6) AS score FROM tr
""")
def kg_triple_quality(spark, sf_dir):
    out = graph.triple_quality(toy_graph(spark, sf_dir)[1])
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "complete", "evidence", "high", "score")])


@query(f"""
WITH RECURSIVE {KG_SQL}, flat AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM tr WHERE s <> o),
tri AS (SELECT count(*) AS triangles FROM flat x JOIN flat y ON x.b = y.a JOIN flat z ON z.a = x.a AND z.b = y.b),
both_ways AS (SELECT a AS u, b AS v FROM flat UNION SELECT b, a FROM flat),
x(id, root) AS (SELECT id, id FROM e UNION SELECT both_ways.v, x.root FROM x JOIN both_ways ON both_ways.u = x.id WHERE both_ways.v IN (SELECT id FROM e)),
sizes AS (SELECT root, count(*) AS n FROM (SELECT id, min(root) AS root FROM x GROUP BY 1) GROUP BY 1),
f AS (SELECT (SELECT count(*) FROM e) AS nodes, (SELECT count(*) FROM tr) AS edges, triangles, (SELECT count(*) FROM sizes) AS components, (SELECT max(n) FROM sizes) AS largest FROM tri),
g AS (SELECT *, edges / (nodes * (nodes - 1)) AS density, largest / nodes AS connectivity, triangles / (CAST(nodes AS DOUBLE) * (nodes - 1) * (nodes - 2) / 6) AS clustering, CASE WHEN nodes > 1 THEN ln(nodes) ELSE 1.0 END AS path_length FROM f)
SELECT nodes, edges, triangles, components, largest, round(density, 9) AS density, round(connectivity, 6) AS connectivity, round(clustering, 9) AS clustering, round(path_length, 6) AS path_length,
       round(0.3 * connectivity + 0.25 * least(density * 10, 1.0) + 0.25 * clustering + 0.2 / greatest(path_length, 1.0), 6) AS score FROM g
""")
def kg_structure(spark, sf_dir):
    out = graph.structure(*toy_graph(spark, sf_dir))
    return out.select("nodes", "edges", "triangles", "components", "largest", F.round("density", 9).alias("density"), r6("connectivity").alias("connectivity"), F.round("clustering", 9).alias("clustering"), r6("path_length").alias("path_length"), r6("score").alias("score"))


@query(f"""
WITH {KG_SQL}, used AS (SELECT s AS id FROM tr UNION SELECT o FROM tr),
f AS (SELECT (SELECT avg(CASE WHEN id IN (SELECT id FROM e) THEN 1.0 ELSE 0.0 END) FROM used) AS reference_share, (SELECT avg(CASE WHEN p = 'REPRESENTS' OR substr(s, 1, 1) = 'c' THEN 1.0 ELSE 0.0 END) FROM tr) AS type_share, 1.0 AS data_share, 1.0 AS time_share)
SELECT round(reference_share, 6) AS reference_share, round(type_share, 6) AS type_share, CAST(data_share AS DOUBLE) AS data_share, CAST(time_share AS DOUBLE) AS time_share, round(0.3 * reference_share + 0.3 * type_share + 0.4, 6) AS score FROM f
""")
def kg_consistency(spark, sf_dir):
    out = graph.graph_consistency(*toy_graph(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in ("reference_share", "type_share", "data_share", "time_share", "score")])


@query(f"""
WITH {KG_SQL}, x AS (SELECT substr(s, 1, 1) AS a, substr(o, 1, 1) AS b, p, c FROM tr) SELECT a AS subject_column, b AS object_column, count(*) AS n, round(avg(c), 6) AS avg_confidence FROM x WHERE a <> 's' GROUP BY 1, 2
""")
def column_relations(spark, sf_dir):
    e, tr = toy_graph(spark, sf_dir)
    e = e.withColumn("source_column", F.left("id", F.lit(1)))
    out = graph.column_relations(tr, e)
    return out.select(F.substring_index("subject_column", ".", -1).alias("subject_column"), F.substring_index("object_column", ".", -1).alias("object_column"), "n", r6("avg_confidence").alias("avg_confidence"))


@query("""
WITH o AS (SELECT o_orderkey, 'c' || o_custkey AS a, 'p' || o_orderpriority AS b FROM orders)
SELECT a, b, count(*) AS n, least(count(*) / 10, 1.0) AS score FROM o GROUP BY 1, 2
""")
def cooccurrence(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source_record_id"), F.lit("orders").alias("source_table"), F.explode(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("p"), F.col("o_orderpriority")))).alias("id"))
    return graph.cooccurrence(o)


@query(f"""WITH {KG_SQL} SELECT 'kg:' || id || ' a kg:' || type || ' ; kg:label "' || replace(label, '"', chr(92) || '"') || '" .' AS value FROM e UNION ALL SELECT 'kg:' || s || ' kg:' || p || ' kg:' || o || ' .' FROM tr""")
def kg_export_turtle(spark, sf_dir):
    from weftline.sources.writers import turtle

    return turtle(*toy_graph(spark, sf_dir))


@query(f"""
WITH {KG_SQL} SELECT 'CREATE (:' || type || ' {{id: "' || id || '", label: "' || label || '", `label`: "' || label || '"}})' AS value FROM e
UNION ALL SELECT 'MATCH (s {{id: "' || s || '"}}), (o {{id: "' || o || '"}}) CREATE (s)-[:' || p || ' {{confidence: ' || CAST(CAST(c AS DOUBLE) AS VARCHAR) || '}}]->(o)' FROM tr
""")
def kg_export_cypher(spark, sf_dir):
    from weftline.sources.writers import cypher

    return cypher(*toy_graph(spark, sf_dir))


# --- events: additions --------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    from weftline.streaming.incremental import tumbling

    out = tumbling(t(spark, sf_dir, "events"), "1 hour", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_session(spark, sf_dir):
    from weftline.streaming.incremental import sessions

    return sessions(t(spark, sf_dir, "events"), "30 minutes", "user_id").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# --- files --------------------------------------------------------------------------------------------------


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment || ', \"' || c_mktsegment || '\"' END AS c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Customers exported as CSV, with quotes, commas and words for nothing, and read back with types."""
    from weftline.sources.readers import read_csv
    from weftline.sources.writers import write_csv

    path = folder(spark, "customers-csv")
    quoted = F.concat("c_mktsegment", F.lit(', "'), "c_mktsegment", F.lit('"'))
    write_csv(t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(quoted)), path)
    return read_csv(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || chr(10) || 'second line' AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_lines_as_text(spark, sf_dir):
    """Nations with line breaks in their names as CSV, read back as text."""
    from weftline.sources.readers import read_csv
    from weftline.sources.writers import write_csv

    path = folder(spark, "nations-csv")
    write_csv(t(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit("\nsecond line"))), path)
    return read_csv(spark, path, strings_only=True)


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand <> 'Brand#1'")
def cleaned_rows(spark, sf_dir):
    """Rows and columns of nulls dropped, names trimmed, equal rows once."""
    from weftline.sources.readers import cleaned

    brand = F.when(F.col("p_brand") != "Brand#1", F.col("p_brand"))
    return cleaned(t(spark, sf_dir, "part").select(brand.alias(" p_brand"), F.when(F.col("p_brand") != "Brand#1", F.col("p_type")).alias("p_type "), F.lit(None).cast("string").alias("nothing")))


UPSERT_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 = 0 OR o_orderstatus <> 'P'"


def upserted(spark, sf_dir, name: str, sink) -> DataFrame:
    """Settled orders stored, then every third order with another price upserted twice."""
    orders, path = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price")), folder(spark, name)
    sink(spark, orders.filter("o_orderstatus <> 'P'").drop("o_orderstatus"), path, "o_orderkey")
    new = orders.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("price") + 1).alias("price"))
    for _ in range(2):
        out = sink(spark, new, path, "o_orderkey")
    return out.select("o_orderkey", "price")


@query(UPSERT_SQL)
def upsert_sink(spark, sf_dir):
    from weftline.sources.writers import upsert_table

    return upserted(spark, sf_dir, "results", upsert_table)


@query(UPSERT_SQL)
def upsert_parts_sink(spark, sf_dir):
    from weftline.sources.writers import upsert_parts

    return upserted(spark, sf_dir, "parted", lambda *x: upsert_parts(*x, parts=16))


@query(f"WITH {KG_SQL} SELECT DISTINCT p AS predicate, s AS subject_id, o AS object_id, 'toy' AS project_name FROM tr WHERE s IN (SELECT id FROM e) AND o IN (SELECT id FROM e)")
def kg_edge_sink(spark, sf_dir):
    """Edges of a project whose ends exist, upserted twice."""
    from weftline.sources.writers import upsert_edges

    e, tr = toy_graph(spark, sf_dir)
    path = folder(spark, "edges")
    for _ in range(2):
        out = upsert_edges(spark, tr, e, path, "toy")
    return out.select("predicate", "subject_id", "object_id", "project_name")


@query(f"""
WITH {KG_SQL} SELECT 'relation:' || p AS relation_id, p AS type, p = 'SIMILAR_TO' AS is_symmetric, p IN ('LOCATED_IN', 'SIMILAR_TO') AS is_transitive, CASE p WHEN 'REPRESENTS' THEN 'MANAGED_BY' WHEN 'MANAGED_BY' THEN 'REPRESENTS' ELSE '' END AS inverse, count(*) AS n, round(avg(c), 6) AS confidence FROM tr GROUP BY p
""")
def kg_relation_types(spark, sf_dir):
    return graph.relation_types(toy_graph(spark, sf_dir)[1]).select("relation_id", "type", "is_symmetric", "is_transitive", "inverse", "n", r6("confidence").alias("confidence"))


@query(f"""
WITH {KG_SQL}, hit AS (SELECT 'entity' AS kind, id, label, confidence FROM e WHERE contains(lower(label), '00001'))
SELECT kind, id, label, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS rn FROM hit) WHERE rn <= 20
UNION ALL SELECT 'triple', s || '|' || p || '|' || o, s || ' ' || p || ' ' || o, round(c, 6) FROM (SELECT *, row_number() OVER (ORDER BY c DESC, s || '|' || p || '|' || o) AS rn FROM tr WHERE contains(s, '00001') OR contains(o, '00001')) WHERE rn <= 20
""")
def kg_search(spark, sf_dir):
    """Entities and triples that hold a text, the most confident of each."""
    return graph.search(*toy_graph(spark, sf_dir), "00001").withColumn("confidence", r6("confidence"))


@query("""
SELECT substr(md5('LOCATION:' || lower('市' || n_name)), 1, 16) AS subject_id, 'LOCATED_IN' AS predicate, substr(md5('ORGANIZATION:' || lower(c_name)), 1, 16) AS object_id, round(0.9 * 0.8, 6) AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def kg_field_names(spark, sf_dir):
    """Relations that the names of two columns tell."""
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("市"), "n_name").alias("address"), "c_name")
    entities = graph.extracted(rows, "c_custkey", {graph.ORGANISATION: ["c_name"], graph.LOCATION: ["address"]}, "customer")
    found = graph.field_name_triples(entities, ["address", "c_name"], lambda a, b: 0.9)
    return found.select("subject_id", "predicate", "object_id", r6("confidence").alias("confidence"))


@query("""
SELECT o_custkey, count(*) AS visits, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, round(count(o_orderdate) / greatest(count(DISTINCT o_orderdate), 1), 6) AS frequency FROM orders GROUP BY o_custkey
""")
def visit_history(spark, sf_dir):
    """First, last and repeated dates of each customer."""
    return stats.visit_history(t(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").withColumn("frequency", r6("frequency"))


@query("SELECT count(*) AS tasks, round(avg(l_quantity), 6) AS avg_seconds, sum(l_linenumber) AS candidates, round(avg(l_linenumber), 6) AS avg_candidates FROM lineitem")
def task_stats(spark, sf_dir):
    """Lines as tasks that took their quantity's seconds and had as many candidates as their number."""
    found = stats.task_stats(t(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber")
    return found.withColumns({c: r6(c) for c in ("avg_seconds", "avg_candidates")})


@query("""
WITH d AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'match' WHEN 'O' THEN 'suspicious' ELSE 'reject' END AS decision, CAST(o_totalprice AS DOUBLE) AS price FROM orders)
SELECT count(*) AS tasks, count_if(decision = 'match') AS "match", count_if(decision = 'suspicious') AS suspicious, count_if(decision = 'reject') AS reject,
  round(100 * count_if(decision = 'match') / count(*), 6) AS match_rate, round(100 * count_if(decision = 'suspicious') / count(*), 6) AS suspicious_rate, round(100 * count_if(decision = 'reject') / count(*), 6) AS reject_rate,
  round(avg(price), 2) AS avg_seconds, round(avg(price / 2), 2) AS avg_plain, round(avg(price / 4), 2) AS avg_tuned FROM d
""")
def decision_stats(spark, sf_dir):
    """Orders as decided tasks."""
    price = F.col("o_totalprice").cast("double")
    decision = F.when(F.col("o_orderstatus") == "F", "match").when(F.col("o_orderstatus") == "O", "suspicious").otherwise("reject")
    tasks = t(spark, sf_dir, "orders").select(decision.alias("decision"), price.alias("seconds"), (price / 2).alias("plain"), (price / 4).alias("tuned"))
    found = stats.decision_stats(tasks, "decision", "seconds", "plain", "tuned")
    return found.withColumns({c: r6(c) for c in found.columns if c.endswith("_rate")} | {c: F.round(c, 2) for c in found.columns if c.startswith("avg_")})


@query("SELECT c_mktsegment AS project_name, count(*) AS entity_count FROM customer WHERE c_mktsegment IS NOT NULL AND trim(c_mktsegment) <> '' GROUP BY c_mktsegment")
def kg_projects(spark, sf_dir):
    """Entities of each project."""
    return graph.projects(t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project_name")))


@query("SELECT c_custkey AS id, c_name AS label, 'ORGANIZATION' AS type, c_mktsegment AS project_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1')")
def kg_nodes(spark, sf_dir):
    """Entities of a type and a project whose label holds a text."""
    entities = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit(graph.ORGANISATION).alias("type"), F.col("c_mktsegment").alias("project_name"))
    return graph.nodes(entities, graph.ORGANISATION, "BUILDING", "1")


#: Suppliers beside the customers of their numbers, and the Jaccard of two lists.
PLACE_PAIRS_SQL = """
p AS (SELECT s_suppkey, x.n_name || '路' || s_suppkey || '号' AS a, y.n_name || CASE WHEN c_custkey % 3 = 0 THEN '镇, ' ELSE '街-' END || c_custkey || '号院' AS b
  FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN nation x ON x.n_nationkey = s_nationkey JOIN nation y ON y.n_nationkey = c_nationkey),
f AS (SELECT *, list_distinct(regexp_extract_all(a, '[\\p{L}\\p{N}]')) AS ca, list_distinct(regexp_extract_all(b, '[\\p{L}\\p{N}]')) AS cb,
  list_filter(['路', '街', '号', '弄', '村', '镇', '院', '中心', '大厦', '广场'], lambda w: contains(a, w)) AS pa, list_filter(['路', '街', '号', '弄', '村', '镇', '院', '中心', '大厦', '广场'], lambda w: contains(b, w)) AS pb FROM p),
j AS (SELECT *, len(list_intersect(ca, cb)) / (len(ca) + len(cb) - len(list_intersect(ca, cb))) AS base, len(list_intersect(pa, pb)) / (len(pa) + len(pb) - len(list_intersect(pa, pb))) AS place FROM f)
"""


def place_pairs(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    pairs = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    pairs = pairs.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_nation")), "s_nationkey")
    pairs = pairs.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_nation")), "c_nationkey")
    middle = F.when(F.col("c_custkey") % 3 == 0, "镇, ").otherwise("街-")
    return pairs.withColumn("a", F.concat("s_nation", F.lit("路"), "s_suppkey", F.lit("号"))).withColumn("b", F.concat("c_nation", middle, "c_custkey", F.lit("号院")))


@query(f"""
WITH {PLACE_PAIRS_SQL} SELECT s_suppkey, round(base, 6) AS fuzzy, round(CASE WHEN contains(b, '街') THEN base * 1.2 ELSE base END, 6) AS levels, round(place * 0.6 + base * 0.4, 6) AS meaning FROM j
""")
def place_strategies(spark, sf_dir):
    """Three ways to compare addresses."""
    found = place_pairs(spark, sf_dir)
    return found.select("s_suppkey", *[r6(S.place_strategy(F.col("a"), F.col("b"), s)).alias(s) for s in ("fuzzy", "levels", "meaning")])


SEGMENT_SQL = "CASE WHEN {a} = {b} THEN 1.0 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.8 ELSE (greatest(length({a}), length({b})) - levenshtein({a}, {b})) / greatest(length({a}), length({b})) END"


@query(f"""
WITH p AS (SELECT s_suppkey, x.n_name AS xc, y.n_name AS yc, r.r_name AS xp, q.r_name AS yp, s_name AS xd, c_name AS yd FROM supplier JOIN customer ON s_suppkey = c_custkey
  JOIN nation x ON x.n_nationkey = s_nationkey JOIN nation y ON y.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = x.n_regionkey JOIN region q ON q.r_regionkey = y.n_regionkey),
s AS (SELECT *, {SEGMENT_SQL.format(a="xp", b="yp")} AS sp, {SEGMENT_SQL.format(a="xc", b="yc")} AS sc, {SEGMENT_SQL.format(a="xd", b="yd")} AS sd FROM p)
SELECT s_suppkey, CAST(round((sp * 0.2 + sc * 0.3 + sd * 0.2) / 0.7, 6) AS DOUBLE) AS score, CAST(CASE WHEN xp = yp AND xc = yc THEN 0.1 WHEN xp = yp OR xc = yc THEN 0.05 ELSE 0 END + CASE WHEN sd > 0.8 THEN 0.05 ELSE 0 END AS DOUBLE) AS bonus FROM s
""")
def address_segments(spark, sf_dir):
    """Addresses by weighted segments, and what equal parts add."""
    nation, region = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("province"), F.col("n_name").alias("city"))

    def side(name, key, label, nation_key):
        rows = t(spark, sf_dir, name).join(places, F.col(nation_key) == F.col("n_nationkey"))
        none = F.lit(None).cast("string")
        parts = F.struct("province", "city", none.alias("district"), F.col(label).alias("detail"))
        keys = F.struct(F.col("province").alias("number"), F.col("city").alias("street"), none.alias("district"), F.col(label).alias("building"))
        return rows.select(F.col(key).alias("s_suppkey"), parts.alias(f"{name}_parts"), keys.alias(f"{name}_keys"))

    both = side("supplier", "s_suppkey", "s_name", "s_nationkey").join(side("customer", "c_custkey", "c_name", "c_nationkey"), "s_suppkey")
    score = S.segmented(F.col("supplier_parts"), F.col("customer_parts"), S.levenshtein)
    return both.select("s_suppkey", r6(score).alias("score"), r6(S.part_bonus(F.col("supplier_keys"), F.col("customer_keys"), S.levenshtein)).alias("bonus"))


@query("""
WITH x AS (SELECT c_custkey, c_name || '公司' AS org, n_name || '路' || c_custkey || '号' AS place, '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone FROM customer JOIN nation ON n_nationkey = c_nationkey),
y AS (SELECT *, '注册: ' || org || ' @ ' || place || ', ' || phone || '; ' || lower(org) AS text FROM x),
w AS (SELECT *, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}_-]+'))) AS label FROM y),
k AS (SELECT *, CASE WHEN contains(label, '公司') THEN 'ORGANIZATION' WHEN contains(label, '路') OR contains(label, '号') THEN 'LOCATION' WHEN regexp_matches(label, '^1[3-9][0-9]{9}$') THEN 'IDENTIFIER' END AS type, instr(text, label) AS pos FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, type, lower(label) ORDER BY pos) AS rn FROM k WHERE type IS NOT NULL)
SELECT substr(md5(type || ':' || lower(label)), 1, 16) AS id, type, label, CAST(c_custkey AS VARCHAR) AS source_record_id, pos - 1 AS text_position, trim(substr(text, greatest(pos - 20, 1), least(pos - 1, 20))) AS context_before, trim(substr(text, pos + length(label), 20)) AS context_after FROM f WHERE rn = 1
""")
def kg_text_entities(spark, sf_dir):
    """Entities named in a sentence about each customer."""
    rows = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    org = F.concat("c_name", F.lit("公司"))
    phone = F.concat(F.lit("138"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    text = F.concat(F.lit("注册: "), org, F.lit(" @ "), "n_name", F.lit("路"), "c_custkey", F.lit("号, "), phone, F.lit("; "), F.lower(org))
    return graph.text_entities(rows.select("c_custkey", text.alias("text")), "c_custkey", "text").drop("source_table", "source_column", "confidence")


@query("""
WITH x AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '公司' WHEN 1 THEN '大学' WHEN 2 THEN '路' ELSE '' END AS label FROM customer)
SELECT c_custkey, round((0.3 * CASE WHEN contains(label, '大学') THEN 0.9 WHEN contains(label, '公司') THEN 0.8 ELSE 0 END + 0.2 * (contains(label, '公司')::INT + contains(label, '大学')::INT) / 21) / 0.5, 6)::DOUBLE AS organisation,
  round(CASE WHEN contains(label, '路') THEN 0.6 * 0.8 ELSE 0 END, 6)::DOUBLE AS location FROM x
""")
def kg_type_scores(spark, sf_dir):
    """How well labels fit a type by patterns and synonyms."""
    four = F.col("c_custkey") % 4
    label = F.concat("c_name", F.when(four == 0, "公司").when(four == 1, "大学").when(four == 2, "路").otherwise(""))
    rows = t(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return rows.select("c_custkey", r6(graph.type_score(F.col("label"), graph.ORGANISATION)).alias("organisation"), r6(graph.type_score(F.col("label"), graph.LOCATION)).alias("location"))

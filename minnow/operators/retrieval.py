"""Ranking over tables of any size: BM25, vectors, rank fusion, and an index of column values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minnow.functions import text as X

K1, B = 1.2, 0.75
RRF_K = 60
MOST_CHARS = 80


def bm25(docs: DataFrame, key: str, query: list[str], field_weights: dict[str, float], tokens: Callable[[Column], Column] = X.tokens) -> DataFrame:
    """key and score > 0 of rows that hold words of query (already tokens; repeats add up).

    Only the query's words are counted, within the row, and rows are read once: their counts, a few numbers each, go
    through one exchange that the statistics of the corpus (one row) and the scores share.
    """
    words = [F.col(f"`{f}`") for f in field_weights]
    rows = docs.select(F.col(key), *(tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in field_weights))
    terms = list(dict.fromkeys(query))
    weights = list(field_weights.values())

    def weighted(n: Callable[[Column], Column]) -> Column:
        parts = [n(w) * F.lit(float(x)) for w, x in zip(words, weights, strict=True)]
        return sum(parts[1:], parts[0])

    counted = rows.select(key, weighted(F.size).alias("__len"), *(weighted(lambda w, t=t: F.size(F.filter(w, lambda y: y == t))).alias(f"__tf{i}") for i, t in enumerate(terms)))
    counted = counted.repartition(F.col(key))
    total = counted.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *(F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + F.lit(float(query.count(t))) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    # Rows without a word of the query have score 0; dropping them before the join would make the two sides read apart.
    return counted.join(F.broadcast(total)).select(key, score.alias("score")).filter("score > 0")


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine of v and a constant vector; null where the lengths differ."""
    v = v.cast("array<double>")
    norm = sum(x * x for x in query) ** 0.5 or 1.0
    q = F.array(*(F.lit(float(x) / norm) for x in query))
    return F.when(F.size(v) == len(query), F.aggregate(F.zip_with(unit(v), q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def cosine_topk(vectors: DataFrame, key: str, column: str, query: list[float], k: int) -> DataFrame:
    return vectors.select(key, cosine(F.col(column), query).alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(k)


def fuse(rankings: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """key and sum of weight / (60 + rank) over rankings (key, rank)."""
    parts = [r.select(F.col(key), (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("part")) for r, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of (key, score), with their rank."""
    best = df.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


INDEX_SCHEMA = "table string, column string, value string, n long, rank long, complete boolean"


def value_index(frame: DataFrame, table: str, columns: list[str], cap: int = 200, samples: int = 3) -> DataFrame:
    """table, column, value, n, rank, complete: the distinct values of each column by frequency, all of them up to cap, else samples.

    One scan a table: columns are unpivoted before the count. Whole values are counted; only what is shown is cut to MOST_CHARS.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    counted = frame.select(pairs.alias("p")).select("p.column", "p.value").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    # Whether a column is complete is counted apart, so that no task ever orders more than cap + 1 values of it.
    sizes = counted.groupBy("column").agg(F.count("*").alias("distinct"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    out = top.join(F.broadcast(sizes), "column").withColumn("complete", F.col("distinct") <= cap)
    return out.filter(F.col("complete") | (F.col("rank") <= samples)).select(F.lit(table).alias("table"), "column", F.substring("value", 1, MOST_CHARS).alias("value"), "n", F.col("rank").cast("long").alias("rank"), "complete")


def value_match(index: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """table, column, value, quality of values that a question names: 4 phrase, 3 whole, 2 prefix, 1 one edit away."""
    low, asked, first = F.lower("value"), X.tokens(F.lit(question)), F.get(X.tokens(F.col("value")), F.lit(0))
    single = F.size(X.tokens(F.col("value"))) == 1

    def grade(t: Column) -> Column:
        return (
            F.when((t == low) | (single & (t == first)), 3)
            .when((F.length(t) >= 4) & F.startswith(low, t), 2)
            .when((F.length(t) >= 5) & (F.levenshtein(t, first) == 1), 1)
            .otherwise(0)
        )

    phrase = (F.length("value") >= 4) & F.contains("value", F.lit(" ")) & F.contains(F.lit(question.lower()), low)
    quality = F.when(phrase, 4).otherwise(F.coalesce(F.array_max(F.transform(asked, grade)), F.lit(0)))
    found = index.select("table", "column", "value", quality.cast("long").alias("quality")).filter("quality > 0")
    return found.orderBy(F.desc("quality"), "table", "column", "value").limit(limit)


def nearest_values(index: DataFrame, table: str, column: str, wanted: str, most: int = 5) -> DataFrame:
    """value and distance of known values that hold wanted (0) or lie within two edits."""
    low, value = wanted.lower(), F.lower("value")
    d = F.when(F.contains(value, F.lit(low)), 0).otherwise(F.levenshtein(value, F.lit(low)))
    known = index.filter((F.col("table") == table) & (F.col("column") == column))
    return known.select("value", d.cast("long").alias("distance")).filter("distance <= 2").orderBy("distance", "value").limit(most)

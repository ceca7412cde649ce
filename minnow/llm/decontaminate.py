"""Benchmark decontamination with DataFrame functions only (operator 1).

Benchmark texts become a set of normalised 8-word windows. The hashes of the set go to every task as
one bitmap of bounded size; training texts are split into words, and the hash of every window is looked
up in it as the rows are scanned. Only windows that hit leave their row, with their words, and are
verified by a join with the set itself. The plan is the same for a benchmark of any size: a larger one
gets a larger bitmap, and beyond the bitmap's bound only more windows that the join throws away.

Defined cases: null or wordless texts have no windows; an item of fewer than 8 words is one window;
null item_ids are left out; repeated item rows count once; repeated document rows each get a result;
a text of any length is scanned whole; an empty benchmark gives no hits; an empty table gives an empty
result; other columns are ignored, and kept by decontaminate(), whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minnow.llm.bits import Members
from minnow.llm.cluster import stored

#: Words of a window.
SIZE = 8
# The characters of words, lower case and either case, and separators.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" + SEPARATOR + "*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def positions(n: Column | str, size: int) -> str:
    """SQL for the first positions of all windows of size words."""
    return f"if({n} >= {size}, sequence(0, {n} - {size}), array())"


def hash_at(size: int) -> str:
    return f"xxhash64({size}, " + ", ".join(f"get(__h, i + {j})" for j in range(size)) + ")"


def hashed(df: DataFrame, *columns: str) -> DataFrame:
    """Words, their count and their hashes beside the given columns."""
    return df.withColumn("__w", words(F.col("text"))).select(*columns, "__w", F.size("__w").alias("__n")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """__m (words), __gram (their text), __g (hash), __items: distinct ids of the items that hold the window, as strings."""
    items = hashed(benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("__item"), "text"), "__item").filter("__n > 0")
    sized = items.withColumn("__m", F.least(F.col("__n"), F.lit(SIZE)))
    starts = sized.select("__item", "__w", "__h", "__m", F.explode(F.sequence(F.lit(0), F.col("__n") - F.col("__m"))).alias("i"))
    code = "CASE __m " + " ".join(f"WHEN {m} THEN {hash_at(m)}" for m in range(1, SIZE + 1)) + " END"
    grams = starts.select("__item", "__m", F.expr(code).alias("__g"), F.array_join(F.slice("__w", F.col("i") + 1, F.col("__m")), " ").alias("__gram"))
    return grams.groupBy("__m", "__gram", "__g").agg(F.collect_set("__item").alias("__items"))


def scan(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, __row, n_words) for each row of docs, and of those with hits (doc_id, __row, __hits, __items).

    __row is a hash of id and text, __hits the (pos, m) of verified windows by position, __items the sorted ids of their items.
    """
    grams = stored(benchmark_windows(benchmark))
    sizes = sorted(r[0] for r in grams.select("__m").distinct().collect())  # at most SIZE
    # The hashes of all windows of each size, one size after the other, behind a null that stands for the row itself.
    counts = [f"greatest(__n - {m - 1}, 0)" for m in sizes]
    before = ["1" + "".join(f" + {c}" for c in counts[:j]) for j in range(len(sizes) + 1)]
    hashes = F.expr(f"concat(array(cast(null as bigint)), {', '.join(f'transform({positions("__n", m)}, i -> {hash_at(m)})' for m in sizes)})" if sizes else "array(cast(null as bigint))")
    base = hashed(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("__row"), "text"), "doc_id", "__row")
    # The array is a column before it is taken apart: so generator and lookup are compiled into one loop, and no window becomes a row of its own.
    rows = base.withColumn("__x", hashes).select("doc_id", "__row", "__n", "__w", F.posexplode_outer("__x").alias("__k", "__g"))
    if sizes:
        rows = rows.filter(F.col("__g").isNull() | Members(grams, "__g").test(F.col("__g")))
    which = lambda values: F.expr("CASE WHEN __k = 0 THEN 0 " + " ".join(f"WHEN __k < {before[j + 1]} THEN {values[j]}" for j in range(len(sizes))) + " END")
    rows = rows.select("doc_id", "__row", "__n", "__w", which(sizes).alias("m"), which([f"__k - ({x})" for x in before]).alias("pos"))
    found = stored(rows.select("doc_id", "__row", F.col("__n").cast("long").alias("n_words"), "m", "pos", F.when(F.col("m") > 0, F.array_join(F.slice("__w", F.col("pos") + 1, F.col("m")), " ")).alias("__gram")))
    verified = found.filter("m > 0").join(grams.select("__gram", F.col("__m").alias("m"), "__items"), ["__gram", "m"])
    hits = verified.groupBy("doc_id", "__row").agg(F.array_sort(F.collect_set(F.struct("pos", "m"))).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("__items"))
    return found.filter("m = 0").select("doc_id", "__row", "n_words"), stored(hits)


def covered(hits: Column) -> Column:
    """Number of words in the union of the windows."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    def step(a: Column, h: Column) -> Column:
        end = F.greatest(a["end"], h["pos"] + h["m"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], h["pos"])).alias("n"))
    return F.aggregate(hits, start, step, lambda a: a["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    rows, hits = scan(docs, benchmark)
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("__row").alias("__of"), "__hits", "__items")
    f = rows.join(hits, rows["doc_id"].eqNullSafe(hits["__id"]) & (rows["__row"] == hits["__of"]), "left")
    n = F.coalesce(F.size("__items"), F.lit(0)).cast("long")
    n = F.greatest(n, F.lit(0).cast("long"))  # the size of null may be -1
    items = F.coalesce(F.array_join("__items", ","), F.lit(""))
    return f.select("doc_id", "n_words", F.coalesce(covered(F.col("__hits")), F.lit(0).cast("long")).alias("n_hit"), n.alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n >= least_items).alias("contaminated"))


def without_spans(text: Column, hits: Column) -> Column:
    """The text without the words of the windows and the separators behind them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    n = F.size(pieces)
    # Kept stretches lie between the ends of what is covered so far and the next window's start.
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("kept"))
    def step(a: Column, h: Column) -> Column:
        gap = F.when(h["pos"] > a["end"], F.array(F.struct(a["end"].alias("a"), h["pos"].alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.struct(F.greatest(a["end"], h["pos"] + h["m"]).alias("end"), F.concat(a["kept"], gap).alias("kept"))
    kept = F.aggregate(hits, start, step, lambda a: F.concat(a["kept"], F.array(F.struct(a["end"].alias("a"), n.alias("b")))))
    lead = F.regexp_extract(text, f"^{SEPARATOR}*", 0)
    return F.concat(lead, F.array_join(F.transform(kept, lambda k: F.array_join(F.slice(pieces, k["a"] + 1, F.greatest(k["b"] - k["a"], F.lit(0))), "")), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", least_items: int = 2) -> DataFrame:
    """The rows of docs without contaminated documents; with remove="spans", hit windows are also cut out of the others.

    With remove="documents", a document goes if it holds windows of least_items items. n_chars, where docs has it, follows the text.
    """
    facts = stored(scan(docs, benchmark)[1].select(F.col("doc_id").alias("__id"), "__row", "__hits", (F.size("__items") >= least_items).alias("__drop")))
    # Only rows that may have hits, by the bitmap of their hashes, meet the facts; the other texts are joined with nothing.
    may = F.coalesce(Members(facts, "__row").test(F.xxhash64("doc_id", "text")), F.lit(False))
    at = lambda c: F.col(f"d.`{c}`")
    hits, drop = F.col("f.__hits"), F.coalesce(F.col("f.__drop"), F.lit(False))
    on = (F.xxhash64(at("doc_id"), at("text")) == F.col("f.__row")) & at("doc_id").eqNullSafe(F.col("f.__id"))
    joined = docs.filter(may).alias("d").join(facts.alias("f"), on, "left").filter(~drop)
    out = []
    cut = F.when(hits.isNotNull(), without_spans(at("text"), hits)).otherwise(at("text"))
    for c in docs.columns:
        if remove == "spans" and c == "text":
            out.append(cut.alias("text"))
        elif remove == "spans" and c == "n_chars":
            out.append(F.when(hits.isNotNull(), F.char_length(cut)).otherwise(at("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(at(c).alias(c))
    return docs.filter(~may).unionByName(joined.select(*out))

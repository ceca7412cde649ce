"""Sharding by extendible hashing (operator 5).

Rows get a 64-bit hash; a bucket is a prefix of its bits. Starting from the empty prefix, only
buckets over the byte limit split on their next bits, so the directory is a prefix-free set of
prefixes of different lengths. The directory is an aggregate: bytes are summed by as many further
bits as the largest open bucket needs to fit, and only for buckets that are still too large; its
size follows the number of shards. Rows find their shard by one join on the first bits. Rows that are
alike in all 64 bits (copies of one row) cannot be split by bits: these are numbered into overflow pages.

Defined cases: null text counts 0 bytes; null doc_id hashes like an empty one; a single row over the
limit, of any length, has a shard of its own; rows of one hash share a shard while they fit; an empty
table gives an empty result; other columns are ignored, and kept by write_shards(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minnow.llm.cluster import stored

LIMIT = 64 << 20
#: Cells that a round may look at beside those it needs: 2 ** SPARE.
SPARE = 16


def bits(hash_column: Column, start: int, n: int) -> Column:
    """n bits of a 64-bit hash, from bit start (0 is the highest)."""
    return F.shiftrightunsigned(F.shiftleft(hash_column, start), 64 - n)


def row_hash() -> Column:
    """The first 64 bits of the MD5 of doc_id and text."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def row_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def copies_a_page(n_bytes: str, limit: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(n_bytes, F.lit(1)))).cast("long")


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard (the prefix's bits, with .page for overflow), depth, n_bytes of the row, shard_bytes."""
    return assigned(docs, limit).drop("h")


def assigned(docs: DataFrame, limit: int) -> DataFrame:
    """shard_documents() with the hash h of each row."""
    rows = stored(docs.select("doc_id", row_hash().alias("h"), row_bytes().alias("n_bytes")))
    open_ = rows.select("h", "n_bytes", F.lit("").alias("prefix"))
    most, n_open, depth, first, done = rows.agg(F.sum("n_bytes")).first()[0] or 0, 1, 0, 0, None
    while True:
        need = max(0, math.ceil(math.log2(max(most / limit, 1)))) + 2
        n = min(64 - depth, max(need, SPARE - math.ceil(math.log2(n_open))) if depth else need)
        first = first or n
        cells = open_.groupBy("prefix", bits(F.col("h"), depth, n).alias("cell")).agg(F.sum("n_bytes").alias("b"))
        # Bytes of every prefix of every cell; a cell's shard is its shortest prefix that fits.
        text = F.lpad(F.bin("cell"), n, "0")
        levels = cells.select("*", text.alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("level")).withColumn("shard", F.concat("prefix", F.substring("bits", F.lit(1), F.col("level"))))
        totals = levels.groupBy("shard").agg(F.sum("b").alias("shard_bytes"))
        fits = levels.join(totals, "shard").groupBy("prefix", "cell").agg(
            F.min(F.when(F.col("shard_bytes") <= limit, F.struct("level", "shard", "shard_bytes"))).alias("fit"), F.first("b").alias("b"), F.first(F.concat("prefix", "bits")).alias("full"))
        fits = stored(fits.select("prefix", "cell", "b", "full", "fit.shard", "fit.shard_bytes"))
        placed = fits.filter(F.col("shard").isNotNull()).select("full", "shard", "shard_bytes")
        done = placed if done is None else done.unionByName(placed)
        left = fits.filter(F.col("shard").isNull())
        n_open, most = left.agg(F.count("*"), F.max("b")).first()
        if not n_open:
            return place(rows, done, first, None, limit)
        open_ = stored(open_.withColumn("cell", bits(F.col("h"), depth, n)).join(left.select("prefix", "cell", "full"), ["prefix", "cell"]).select("h", "n_bytes", F.col("full").alias("prefix")))
        depth += n
        if depth >= 64:
            return place(rows, done, first, open_.select("h").distinct(), limit)


def place(rows: DataFrame, directory: DataFrame, first: int, stuck: DataFrame | None, limit: int) -> DataFrame:
    """Give each row the shard of its cell, by a join on its first bits; rows of full 64-bit cells over the limit (stuck) go to overflow pages."""
    path = F.lpad(F.bin("h"), 64, "0")
    cells = stored(directory.groupBy(F.substring("full", 1, first).alias("first")).agg(F.collect_list(F.struct("full", "shard", "shard_bytes")).alias("cells")))
    mine = F.get(F.filter("cells", lambda c: F.startswith(path, c["full"])), F.lit(0))
    found = rows.withColumn("first", F.substring(path, 1, first)).join(cells, "first").withColumn("at", mine).filter(F.col("at").isNotNull())
    out = found.select("doc_id", "h", "at.shard", F.length("at.shard").cast("long").alias("depth"), "n_bytes", "at.shard_bytes")
    if stuck is None:
        return out
    same = rows.join(stuck, "h").groupBy("h", "doc_id", "n_bytes").agg(F.count("*").alias("n"))
    copies = same.withColumn("per", copies_a_page("n_bytes", limit)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("page", F.floor(F.col("i") / F.col("per")).cast("long"))
    held = F.least("per", F.col("n") - F.col("page") * F.col("per")) * F.col("n_bytes")
    return out.unionByName(copies.select("doc_id", "h", F.concat(path, F.lit("."), F.col("page")).alias("shard"), F.lit(64).cast("long").alias("depth"), "n_bytes", held.alias("shard_bytes")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write whole documents under path, one directory a shard; return the directory of shards.

    Every row is written once, whatever its nulls and copies; an empty table writes no shard. A row's hash gives its
    shard. Rows in overflow pages are numbered within the stored part of the table
    they are in, from where the parts before it end, so that no task gets all copies of a row.
    """
    placed = stored(assigned(docs, limit))
    paged = F.col("shard").contains(".")
    keyed = docs.withColumns({"__h": row_hash(), "__n": row_bytes()})
    whole = keyed.join(placed.filter(~paged).select(F.col("h").alias("__h"), "shard").distinct(), "__h").select(*docs.columns, "shard")
    over = keyed.join(F.broadcast(placed.filter(paged).select(F.col("h").alias("__h")).distinct()), "__h", "left_semi")
    over = stored(over.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    row = ["__h", "doc_id", "__n"]
    counts = over.groupBy(*row, "__part").agg(F.count("*").alias("__k"))
    before = Window.partitionBy(*row).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__h", F.col("doc_id").alias("__id"), "__n", "__part", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__start"))
    over = over.withColumn("__i", F.row_number().over(Window.partitionBy(*row, "__part").orderBy("__row")) - 1)
    over = over.join(starts, ["__h", "__n", "__part"]).filter(F.col("doc_id").eqNullSafe(F.col("__id")))
    page = F.floor((F.col("__start") + F.col("__i")) / copies_a_page("__n", limit)).cast("long")
    over = over.select(*docs.columns, F.concat(F.lpad(F.bin("__h"), 64, "0"), F.lit("."), page).alias("shard"))
    whole.unionByName(over).repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("n"))

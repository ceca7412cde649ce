"""Where tables come from: a folder of Parquet files, the session's catalog, or JDBC. Only Spark opens paths."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from minnow.errors import SourceError
from minnow.sources import jdbc as J

Frames = dict[str, Callable[[], DataFrame]]


def parquet_dir(spark: SparkSession, path: str, names: Iterable[str]) -> Frames:
    """A table is a file or folder name.parquet; it is opened when it is first asked for."""
    return {n: partial(spark.read.parquet, f"{path.rstrip('/')}/{n}.parquet") for n in names}


def folded(names: Iterable[tuple[str, str]], current: str) -> dict[str, str]:
    """Full names by the names that tables go by: those of the current database without it, others with it.

    Names that differ in case alone would not be told apart by callers and are refused.
    """
    out = {table if database == current else f"{database}.{table}": f"{database}.{table}" for database, table in names}
    if len({n.lower() for n in out}) < len(out):
        raise SourceError("two tables have names that differ in case alone")
    return out


def spark_catalog(spark: SparkSession, *databases: str) -> Frames:
    """Tables of these databases of the session's catalog, or of the current one."""
    current = spark.catalog.currentDatabase()
    found = [(d, t.name) for d in databases or (current,) for t in spark.catalog.listTables(d) if not t.isTemporary]
    views = {t.name: partial(spark.table, t.name) for t in spark.catalog.listTables(current) if t.isTemporary}
    return views | {n: partial(spark.table, full) for n, full in folded(found, current).items()}


def jdbc(spark: SparkSession, url: str, names: Iterable[str], **options: str) -> Frames:
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load for n in names}


ADAPTERS = {"parquet_dir": parquet_dir, "spark_catalog": spark_catalog, "jdbc": jdbc, "jdbc_catalog": J.catalog}


def key_violations(child: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """One row: orphans (child rows whose key has no parent) and repeated parent keys."""
    from pyspark.sql import functions as F

    left = child.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns))).dropna()
    right = parent.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(parent_columns)))
    keys = [f"k{i}" for i in range(len(columns))]
    orphans = left.join(right, keys, "left_anti").agg(F.count("*").alias("orphans"))
    repeats = right.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated_keys"))
    return orphans.join(F.broadcast(repeats)).select("orphans", F.coalesce("repeated_keys", F.lit(0).cast("long")).alias("repeated_keys"))
